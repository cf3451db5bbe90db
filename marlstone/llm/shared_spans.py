"""Long exact spans shared between records.

Method: repeated-phrase automata. Of every window of ``span`` characters one phrase of ``phrase`` characters is selected by its hash (winnowing),
so two texts that share ``span`` characters select a common phrase. Phrases selected in more than one text recur; they are compiled into
sharded Aho-Corasick automata, sharded by the text in which a phrase was seen first, and every text is streamed through the automata
of the shards that its own recurring phrases belong to, which locates every occurrence. Occurrences are extended by their neighbouring
characters, and pairs with ``span`` characters in common remain.

Equal texts are one class and take part once. Equal surroundings of a phrase are one context, and pairs are formed between contexts, not
documents. A phrase with many contexts is not paired all with all: its contexts are grouped by each window of ``span`` characters around the
phrase, so that only contexts that truly share one meet. What of a text is shared is told by the windows that more than one text holds, without any pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, parallelism, spread

PHRASES_PER_SHARD = 4000
TEXTS_PER_TASK = 4000
FEW_CONTEXTS = 32
PHRASE, TEXT = 0, 1  # kinds of rows that go to a shard; phrases come first
BASE = np.uint64(0x9E3779B97F4A7C15)


def phrase_hashes(text: str, phrase: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``phrase`` characters, from one running polynomial over code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    value = np.zeros(len(points) - phrase + 1, np.uint64)
    # doubling: hash of 2k characters = hash of k, times base^k, plus hash of the next k
    with np.errstate(over="ignore"):
        power, block, size, done = BASE, points + np.uint64(1), 1, 0
        mult = np.uint64(1)
        n = phrase
        while n:
            if n & 1:
                value = value * power + block[done:done + len(value)]
                done += size
            n >>= 1
            if n:
                block = block[:-size] * power + block[size:]
                power, size = power * power, 2 * size
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
    return value


def selected(text: str, span: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the rightmost least phrase of each window of ``span`` characters."""
    h = phrase_hashes(text, phrase)
    width = span - phrase + 1
    at = np.arange(len(h))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        reach += step
    at = np.unique(at)
    return at, h[at].view(np.int64)


def _select(span: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc, text in zip(batch["doc"], batch["text"]):
                at, h = selected(text, span, phrase)
                h, first = np.unique(h, return_index=True)
                parts.append(pd.DataFrame({"doc": doc, "at": at[first], "hash": h}))
            if parts:
                yield pd.concat(parts)

    return run


def _phrases(phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(shard, h, text[at:at + phrase]) for shard, text, places in zip(batch["shard"], batch["text"], batch["places"])
                    for h, at in ((p["hash"], p["at"]) for p in places)]
            yield pd.DataFrame(rows, columns=["shard", "hash", "text"])

    return run


def _locate(span: int, phrase: int):
    """Per (shard, salt): first the phrases, then the texts, of which every occurrence is located."""
    around = span - phrase

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, automaton, ready = None, None, False
        for batch in batches:
            out = []
            for shard, salt, kind, doc, h, text in zip(batch["shard"], batch["salt"], batch["kind"], batch["doc"], batch["hash"], batch["text"]):
                if (shard, salt) != key:
                    key, automaton, ready = (shard, salt), ahocorasick.Automaton(), False
                if kind == PHRASE:
                    automaton.add_word(text, h)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                seen: dict[tuple[int, str, str], list[int]] = {}
                for end, found in automaton.iter(text):
                    start = end - phrase + 1
                    seen.setdefault((found, text[max(0, start - around):start], text[end + 1:end + 1 + around]), []).append(start)
                out += [(found, doc, left, right, starts) for (found, left, right), starts in seen.items()
                        if len(left) + len(right) >= around]
            yield pd.DataFrame(out, columns=["hash", "doc", "left", "right", "starts"])

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _pair(around: int):
    """Pairs of the few contexts of one phrase, by comparing them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for contexts in batch["contexts"]:
                rows = [(c["context"], c["left"][::-1], c["right"]) for c in contexts]
                for i, (x, xl, xr) in enumerate(rows):
                    for y, yl, yr in rows[i + 1:]:
                        left = _common(xl, yl)
                        right = _common(xr, yr)
                        if left + right >= around:
                            out.append((min(x, y), max(x, y), left, right))
            yield pd.DataFrame(out, columns=["x", "y", "before", "after"])

    return run


class SharedSpans:
    """The tables of one run: classes of equal texts, contexts and their pairs. Null texts and texts shorter than ``span`` share nothing."""

    def __init__(self, docs: DataFrame, span: int = 200, phrase: int = 100, id_col: str = "doc_id", text_col: str = "text"):
        if not 1 < phrase < span:
            raise ValueError("need 1 < phrase < span")
        spark = docs.sparkSession
        self.span, self.phrase, around = span, phrase, span - phrase
        long = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= span)).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        keyed = cut(long.select(F.col("doc").alias("id"), F.unhex(F.sha2("text", 256)).alias("key"), F.length("text").alias("chars"))
                    .dropDuplicates(["id"]))
        heads = keyed.groupBy("key").agg(F.min("id").alias("doc"), F.count("*").alias("members"), F.first("chars").alias("chars"))
        self.members = cut(keyed.select("id", "key").join(heads, "key").select("id", "doc", "members", "chars"))
        self.heads = self.members.where("id = doc").select("doc", "members", "chars")

        # copies are marked as well and left out afterwards: that costs less than to move the texts
        marks = cut(spread(long).mapInPandas(_select(span, phrase), "doc bigint, at int, hash bigint")
                    .join(self.heads.select("doc"), "doc", "left_semi").dropDuplicates(["doc", "hash"]))
        recurring = cut(marks.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("lead"))
                        .where("n > 1").select("hash", "lead"))
        shards = max(1, -(-recurring.count() // PHRASES_PER_SHARD))
        shard = F.pmod(F.xxhash64("lead.doc"), F.lit(shards)).cast("int").alias("shard")
        places = (recurring.groupBy(F.col("lead.doc").alias("doc"))
                  .agg(F.collect_list(F.struct("hash", F.col("lead.at").alias("at"))).alias("places")))
        routes = cut(marks.join(recurring, "hash").select("doc", shard).distinct())
        # every text that holds a recurring phrase, its shards and the phrases it was the first to hold: the texts move once
        needed = routes.groupBy("doc").agg(F.collect_list("shard").alias("shards")).join(places, "doc", "left")
        texts = cut(long.join(needed, "doc").dropDuplicates(["doc"]))
        phrases = (texts.where("places is not null").select(
            F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard"), "text", "places")
            .mapInPandas(_phrases(phrase), "shard int, hash bigint, text string"))
        salts = routes.groupBy("shard").agg(F.ceil(F.count("*") / TEXTS_PER_TASK).cast("int").alias("salts"))
        phrases = (phrases.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                       F.lit(PHRASE).alias("kind"), F.lit(0).cast("bigint").alias("doc"), "hash", "text"))
        streamed = (texts.select("doc", "text", F.explode("shards").alias("shard")).join(salts, "shard")
                    .select("shard", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(TEXT).alias("kind"), "doc",
                            F.lit(0).cast("bigint").alias("hash"), "text"))
        located = (phrases.unionByName(streamed).repartition(parallelism(spark), "shard", "salt")
                   .sortWithinPartitions("shard", "salt", "kind")
                   .mapInPandas(_locate(span, phrase), "hash bigint, doc bigint, left string, right string, starts array<int>"))
        context = F.unhex(F.md5(F.concat_ws("|", "hash", F.length("left"), "left", "right")))
        located = cut(located.withColumn("context", context))
        self.places = located.select("context", "doc", "starts")

        contexts = cut(located.groupBy("context").agg(
            F.first("hash").alias("hash"), F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("docs"),
            F.min("doc").alias("one"), F.max("doc").alias("last")))
        self.holders = contexts.select("context", "docs", "one")
        sizes = contexts.groupBy("hash").agg(F.count("*").alias("n"))
        few = contexts.join(sizes.where((F.col("n") > 1) & (F.col("n") <= FEW_CONTEXTS)), "hash", "left_semi")
        compared = (few.groupBy("hash").agg(F.collect_list(F.struct("context", "left", "right")).alias("contexts"))
                    .mapInPandas(_pair(around), "x binary, y binary, before int, after int"))
        many = contexts.join(sizes.where(F.col("n") > FEW_CONTEXTS), "hash", "left_semi")
        low, high = F.greatest(F.lit(0), around - F.length("right")), F.least(F.lit(around), F.length("left"))
        windows = (many.select("context", "one", "last", "hash", "left", "right", F.explode(F.sequence(low, high)).alias("before"))
                   .select("context", "one", "last", "before", F.unhex(F.md5(F.concat_ws(
                       "|", "hash", "before", F.expr("right(left, before)"),
                       F.substring("right", F.lit(1), F.lit(around) - F.col("before"))))).alias("window")))
        # windows in more than one text; those of one context alone need no pairs
        shared = windows.groupBy("window").agg(F.count("*").alias("n"), F.min("one").alias("one"), F.max("last").alias("last")).where("one <> last")
        self.windows = cut(windows.select("context", "before", "window").join(shared.select("window", "n"), "window"))
        self.compared = cut(compared)
        self.alone = contexts.where("docs > 1").select(
            F.col("context"), F.length("left").alias("before"), F.length("right").alias("after"))

    def head_pairs(self) -> DataFrame:
        """(a, b): pairs of classes, a < b, that share a span."""
        at = self.places.select("context", "doc")
        met = self.windows.where("n > 1").select("window", F.col("context").alias("x"))
        met = met.join(met.withColumnRenamed("x", "y"), "window").where("x < y")
        linked = self.compared.select("x", "y").unionByName(met.select("x", "y")).distinct().unionByName(
            self.alone.select(F.col("context").alias("x"), F.col("context").alias("y")))
        return (linked.join(at.withColumnsRenamed({"context": "x", "doc": "a"}), "x")
                .join(at.withColumnsRenamed({"context": "y", "doc": "b"}), "y").where("a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def pairs(self) -> DataFrame:
        """(doc_id, other_doc_id): all pairs of ids, copies expanded."""
        heads = self.head_pairs().unionByName(self.heads.where("members > 1").select(F.col("doc").alias("a"), F.col("doc").alias("b")))
        members = self.members
        return (heads.join(members.select(F.col("doc").alias("a"), F.col("id").alias("i")), "a")
                .join(members.select(F.col("doc").alias("b"), F.col("id").alias("j")), "b").where("a <> b or i < j")
                .select(F.least("i", "j").alias("doc_id"), F.greatest("i", "j").alias("other_doc_id")))

    def coverage(self) -> DataFrame:
        """(doc_id, class_id, spans, shared_chars, share): per document its maximal shared spans (start, end) and their part of the text."""
        # a span that only the same document holds again isn't shared: whose the other context is goes along
        sides = self.compared.select(F.explode(F.array(F.struct(F.col("x").alias("context"), F.col("y").alias("other")),
                                                       F.struct(F.col("y").alias("context"), F.col("x").alias("other")))).alias("s"), "before", "after")
        others = self.holders.select(F.col("context").alias("other"), F.when(F.col("docs") == 1, F.col("one")).alias("only"))
        both = (sides.select("s.context", "s.other", "before", "after").join(others, "other").select("context", "before", "after", "only"))
        # neighbouring windows of a context are one stretch
        row = F.row_number().over(Window.partitionBy("context").orderBy("before"))
        stretches = (self.windows.select("context", "before", (F.col("before") - row).alias("run")).groupBy("context", "run")
                     .agg(F.max("before").alias("before"), (F.lit(self.span - self.phrase) - F.min("before")).alias("after")))
        nobody = F.lit(None).cast("bigint").alias("only")
        reach = (both.distinct().unionByName(self.alone.select("context", "before", "after", nobody))
                 .unionByName(stretches.select("context", "before", "after", nobody)))
        pieces = (self.places.join(reach, "context").where("only is null or only <> doc").select("doc", F.explode("starts").alias("s"), "before", "after")
                  .select("doc", (F.col("s") - F.col("before")).alias("start"), (F.col("s") + self.phrase + F.col("after")).alias("end"))
                  .groupBy("doc", "start").agg(F.max("end").alias("end")))
        # pieces that touch are one span: a span begins where no piece before reaches
        order = Window.partitionBy("doc").orderBy("start")
        reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = pieces.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
        spans = (opened.withColumn("k", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                 .groupBy("doc", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")))
        ordered = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("merged"))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("chars").alias("end")))
        spans = F.when(F.col("members") > 1, whole).otherwise(F.coalesce("merged", empty))
        total = F.aggregate("spans", F.lit(0), lambda a, p: a + p["end"] - p["start"])
        return (self.members.join(ordered, "doc", "left")
                .select(F.col("id").alias("doc_id"), F.col("doc").alias("class_id"), spans.alias("spans"), "chars").where(F.size("spans") > 0)
                .select("doc_id", "class_id", "spans", total.cast("bigint").alias("shared_chars"), F.round(total / F.col("chars"), 6).alias("share")))
