"""Evaluation texts leaking into training text.

Method: the test items' passages form a BM25 inverted index (postings cut into blocks, each with its largest score). Every
document is cut into overlapping passages of ``width`` words; each passage queries the index with block-max WAND, which skips
blocks that can't reach the threshold, and returns every item above it. The threshold of an item is the least score that any
``run`` consecutive words of its own passage give, so no item of which a passage holds such a run is missed. Hits are verified
word by word.

The index is broadcast in blocks of items of at most ``block_bytes`` of text each; more items make more passes over
the documents, not a larger broadcast.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

WORD = re.compile(r"[^\W_]+")
K1, B = 1.5, 0.75
POSTINGS_PER_BLOCK = 16
NO_MORE = 1 << 60


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Postings:
    """One term's items in ascending order with their scores, in blocks with a largest score each."""

    __slots__ = ("items", "scores", "block_last", "block_max", "most")

    def __init__(self, entries: list[tuple[int, float]]):
        entries.sort()
        self.items = [i for i, _ in entries]
        self.scores = [s for _, s in entries]
        cuts = range(0, len(entries), POSTINGS_PER_BLOCK)
        self.block_last = [self.items[min(c + POSTINGS_PER_BLOCK, len(entries)) - 1] for c in cuts]
        self.block_max = [max(self.scores[c:c + POSTINGS_PER_BLOCK]) for c in cuts]
        self.most = max(self.scores)


class Index:
    """Scores are divided by their item's threshold, so that the threshold is 1 for all."""

    def __init__(self, items: list[tuple[int, str, str]], run: int):
        self.run = run
        rows = [(i, words(p), set(words(q))) for i, q, p in items]
        rows = [r for r in rows if len(r[1]) >= run]
        self.ids = [r[0] for r in rows]
        self.questions = [r[2] for r in rows]
        self.texts = [r[1] for r in rows]
        self.runs: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        df = Counter(t for _, w, _ in rows for t in set(w))
        mean = sum(len(w) for _, w, _ in rows) / max(1, len(rows))
        entries: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for n, (_, w, _) in enumerate(rows):
            norm = K1 * (1 - B + B * len(w) / mean)
            score = {t: math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                     for t, tf in Counter(w).items()}
            windows = [w[k:k + run] for k in range(len(w) - run + 1)]
            least = min(sum(score[t] for t in set(x)) for x in windows)
            for t, s in score.items():
                entries[t].append((n, s / least))
            for k, x in enumerate(windows):
                self.runs[tuple(x)].append((n, k))
        self.postings = {t: Postings(e) for t, e in entries.items()}

    def search(self, terms: set[str]) -> list[int]:
        """Block-max WAND: all items whose score for the distinct ``terms`` is at least 1."""
        lists = [self.postings[t] for t in terms]
        enough = 1 - 1e-9
        if sum(p.most for p in lists) < enough:
            return []
        cursors = [[p.items[0], 0, p] for p in lists]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == NO_MORE:
                    break
                bound += c[2].most
                if bound >= enough:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, next_border = 0.0, NO_MORE
            for c in cursors[:pivot + 1]:
                block = bisect_left(c[2].block_last, item)
                if block < len(c[2].block_last):
                    bound += c[2].block_max[block]
                    next_border = min(next_border, c[2].block_last[block] + 1)
            if bound >= enough:
                if cursors[0][0] == item:
                    score = sum(c[2].scores[c[1]] for c in cursors[:pivot + 1])
                    if score >= enough:
                        found.append(item)
                    target = item + 1
                else:
                    target = item
            else:
                # no item before the nearest block border, nor before the next list begins, can reach the threshold
                target = min(next_border, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else NO_MORE)
                target = max(target, item + 1)
            for c in cursors[:pivot + 1]:
                if c[0] < target:
                    c[1] = bisect_left(c[2].items, target, c[1])
                    c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else NO_MORE

    def leaks(self, text: str, width: int) -> dict[int, set[int]]:
        """For each leaked item the places of its passage at which a run begins that ``text`` holds."""
        all_words = words(text)
        out: dict[int, set[int]] = {}
        step = width - self.run + 1
        for a in range(0, max(1, len(all_words) - self.run + 1), step):
            passage = all_words[a:a + width]
            if len(passage) < self.run:
                break
            terms = {w for w in passage if w in self.postings}
            if not terms:
                continue
            hits = self.search(terms)
            if hits:
                # verification of the retrieved items, word by word
                wanted = set(hits)
                for k in range(len(passage) - self.run + 1):
                    for n, at in self.runs.get(tuple(passage[k:k + self.run]), ()):
                        if n in wanted:
                            out.setdefault(n, set()).add(at)
        return out


_cache: dict[object, Index] = {}


def find_leaks(docs: DataFrame, items: DataFrame, run: int = 12, width: int = 64, block_bytes: int = 4 << 20,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, passage_share, question_share): documents with at least ``run`` consecutive words of an item's passage; the share of the passage's
    words in such runs, and of the question's distinct words that occur in the document. Null texts, null or short
    passages match nothing; duplicates of an id count once."""
    spark = docs.sparkSession
    rows = (items.where("item_id is not null and passage is not null")
            .select("item_id", F.coalesce("question", F.lit("")).alias("question"), "passage"))
    size = rows.agg(F.sum(F.octet_length("passage") + F.octet_length("question")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    texts = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    def block(b: int) -> DataFrame:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.distinct().collect()])
        token = uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if token not in _cache:
                _cache.clear()
                _cache[token] = Index(shared.value, run)
            index = _cache[token]
            for batch in batches:
                out = []
                for d, t in zip(batch["doc_id"], batch["text"]):
                    for n, places in index.leaks(t, width).items():
                        covered = len({p + k for p in places for k in range(run)})
                        question = index.questions[n]
                        share = len(question & set(words(t))) / len(question) if question else 0.0
                        out.append((d, index.ids[n], round(covered / len(index.texts[n]), 6), round(share, 6)))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "passage_share", "question_share"])

        return texts.mapInPandas(scan, "doc_id bigint, item_id bigint, passage_share double, question_share double")

    found = block(0)
    for b in range(1, blocks):
        found = found.unionByName(block(b))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("passage_share").alias("passage_share"), F.max("question_share").alias("question_share"))
