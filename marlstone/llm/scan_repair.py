"""Noise in text from scanned pages.

Method: a noisy channel. Scanned texts are told by wrapped lines, words hyphenated across lines and misreads. Page numbers and running heads and feet are found at the edges of the
pages, words hyphenated across lines are put together, and every line is decoded by Viterbi over the candidate words of each token: the probability
that the candidate's characters were misread as the token's, times the likelihood of word pairs in the corpus. The counts are taken over all
texts that weren't scanned (over all texts if there are none); words that fewer than ``least_share`` of those have (but at least
``least_docs``) are left out, which bounds what is broadcast by the words of a document divided by that share, whatever the number of documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread

TAG = re.compile(r"\W*\[(?:PAGE|SHEET|ROW)\b[^\]]*\]?", re.IGNORECASE)
PAGE_TAG = re.compile(r"\W*\[\s*PAGE\s+\d+\s*\]\W*", re.IGNORECASE)
LABEL = re.compile(r"\W*[^\W\d_][\w ]{0,20}:\s|(?:section|chapter|rule)\b", re.IGNORECASE)
HYPHENS = "-‐‑¬­"
BROKEN = re.compile(rf"(\w+)[{HYPHENS}]\s*$")
ROMAN = r"(?:[ivxl]{1,7})"
# a line with only a page number, in digits (some misread as letters) or Roman numerals; fixed pattern
NUMBER = re.compile(
    rf"[\W_]*(?:(?:page|pag|pg|p|seite|página|folio)\b[\W_]*)?(?:[\dOoIlZSB]{{0,3}}\d[\dOoIlZSB]{{0,3}}|{ROMAN})"
    rf"(?:[\W_]*(?:of|0f|von|de|sur)\b[\W_]*(?:[\dOoIlZSB]{{1,4}}|{ROMAN})|\s*/\s*\d{{1,4}})?[^\w.]*", re.IGNORECASE)
# forms that nothing but a page number has, wherever on the page
NUMBER_ONLY = re.compile(rf"(?:page|pag|pg|p)\b[\W_]*[\dOoIlZSB]+(?:\W+[o0]f\W+[\dOoIlZSB]+)?|[-–—]\s*(?:\d{{1,4}}|{ROMAN})\s*[-–—]|\[\s*\d{{1,4}}\s*\]", re.IGNORECASE)
NUMBERED = re.compile(r"\d+[A-Z]?\. ")  # a numbered clause begins, no sentence goes on
MISREAD = re.compile(r"[^\W\d_]{2}[\d†!@|+][^\W\d_]{2}|[^\W\d_][†!@|ﬁﬂﬀ+][^\W\d_]|[†ﬁﬂﬀ]")
SLACK = 3  # characters by which misreads and stray marks change a line's width
WIDE = 75  # narrower lines are judged by the share that goes on in lower case alone
WORD_LIMIT = 64  # a longer stretch without spaces isn't a word and has no candidates
COUNTED = 1 << 17  # distinct words and pairs that a task holds at once, beside those of one document
APPLIED = 256  # documents whose rows a task holds at once
CANDIDATES = 1 << 16  # tokens whose candidates a worker holds
EDGE = 6  # lines of a page among which its head, foot and number are sought, site lines between included

# fixed values: what is read for what is printed
CONFUSIONS = {
    "m": ["rn"], "rn": ["m"], "d": ["cl"], "cl": ["d"], "h": ["li", "b"], "li": ["h"], "u": ["ii"], "ii": ["u"], "w": ["vv"], "vv": ["w"],
    "e": ["c"], "c": ["e"], "s": ["5"], "o": ["0"], "i": ["!", "l", "1", "j"], "l": ["1", "i", "|", "!"], "t": ["†", "f", "+"], "f": ["t"],
    "g": ["q", "9"], "q": ["g"], "fi": ["ﬁ", "fl"], "fl": ["ﬂ"], "ff": ["ﬀ"], "b": ["6", "h"], "n": ["ri", "u"], "y": ["v"], "v": ["y"], "a": ["o", "@"],
    "z": ["2"], "k": ["lc"], "r": ["n"], "0": ["o"], "1": ["l", "i", "!", "|"], "2": ["z"], "5": ["s"], "6": ["b", "g"], "8": ["b"], "9": ["g", "q"], "7": ["t"],
}
PRINTED = defaultdict(list)
for _true, _seen in CONFUSIONS.items():
    for _s in _seen:
        PRINTED[_s].append(_true)
ERROR, OTHER_ERROR = math.log(0.004), math.log(0.0002)
UNKNOWN, UNKNOWN_NAME = math.log(1e-8), math.log(2e-5)
PAIR_WEIGHT = 0.9
START = "<"


@lru_cache(1 << 16)
def core(token: str) -> tuple[str, str, str]:
    """(before, core, after): a token without punctuation around it; marks that may be misread letters stay."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in "†!@|+" and b - a > 1):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] == "†"):
        b -= 1
    return token[:a], token[a:b], token[b:]


@lru_cache(1 << 16)
def shape(word: str) -> str:
    """Lower case, each run of digits as one #."""
    return re.sub(r"\d+", "#", word.lower())


def is_scanned(filename: str | None, text: str) -> bool:
    """A PDF of wrapped lines. Evidence is any of: a word hyphenated across lines; a printed page number; a misread character inside a word
    beside a wrap; lines that go on in lower case, many for all lines; body text broken at one common width. For the last, only the text that is
    wrapped or too long for that width is weighed, so titles, headings, labels, furniture and short site lines have no say."""
    if filename is not None and not filename.lower().endswith(".pdf"):
        return False
    lines = [x.strip() for x in text.split("\n")]
    total = low = 0
    wraps: list[tuple[int, int, int, bool]] = []  # place, the widths it may be broken at, goes on in lower case
    for i, (a, b) in enumerate(zip(lines, lines[1:] + [""])):
        if not a:
            continue
        if len(a) <= 24 and not PAGE_TAG.fullmatch(a) and NUMBER_ONLY.fullmatch(a):
            return True
        if TAG.match(a):
            continue
        total += 1
        if not (50 <= len(a) <= 120 and a[-1] not in ".:;?!" and b and not TAG.match(b) and not LABEL.match(b)):
            continue
        hyphen = bool(BROKEN.search(a))
        if hyphen and b[0].islower():
            return True
        low += b[0].islower() or b[0].isdigit() or a.isupper() and b.isupper() and not LABEL.match(a)
        if not NUMBERED.match(b):
            # the next word didn't fit
            end = len(a) + SLACK + 8 if hyphen else len(a) + len(b.split(None, 1)[0]) + SLACK
            wraps.append((i, len(a) - SLACK, end, b[0].islower() or b[0].isdigit()))
    if low >= 2 and low >= 0.24 * total:
        return True
    if not wraps:
        return False
    if MISREAD.search(text):
        return True
    at = Counter(w for _, least, most, _ in wraps for w in range(least, most + 1))
    width = max((least + SLACK for _, least, _, _ in wraps), key=lambda w: (at[w], w))
    if width < WIDE:
        return False  # short lines of the site are as even as a narrow column
    full = [(i, goes_on) for i, least, most, goes_on in wraps if least <= width <= most]
    unwrapped = sum(len(x) > width + SLACK and not TAG.match(x) and not LABEL.match(x) for x in lines)
    if len(full) > unwrapped and (any(goes_on for _, goes_on in full) or len(full) >= 3 and not unwrapped):
        return True
    # few wraps: one must be a sentence that ends in the next line
    return len(full) >= unwrapped and any(
        lines[i + 1].endswith(".") and not lines[i + 1].isupper() and lines[i + 1][0].isalnum() and len(lines[i + 1]) <= width + SLACK
        and (i == 0 or not lines[i - 1] or TAG.match(lines[i - 1])) for i, _ in full)


def _plain(line: str) -> str:
    """A running line without its page number, case and punctuation."""
    words = re.findall(r"[^\W_]+", line.lower())
    number = re.compile(rf"\d{{1,4}}|{ROMAN}|page|of")
    while words and number.fullmatch(words[0]):
        words.pop(0)
    while words and number.fullmatch(words[-1]):
        words.pop()
    return " ".join(words)


@lru_cache(1 << 11)
def _bigrams(text: str) -> frozenset[str]:
    return frozenset(map("".join, zip(text, text[1:])))


def _alike(a: str, b: str) -> bool:
    """Equal but for a few misread characters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 3:
        return False
    # a character that finds no partner takes two bigrams with it at most
    if len(_bigrams(a) - _bigrams(b)) > 0.16 * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() > 0.9 and m.ratio() > 0.92


def furniture(lines: list[str]) -> set[int]:
    """Indexes of the lines that are only a page number, or a running head or foot."""
    pages: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if PAGE_TAG.fullmatch(line.strip() or " "):
            pages.append([])
        elif line.strip() and not TAG.match(line):
            pages[-1].append(i)
    pages = [p for p in pages if p]
    found: set[int] = set()
    for p in pages:
        for i in p[-EDGE:] + p[:EDGE]:
            if NUMBER.fullmatch(lines[i].strip()) and len(lines[i].strip()) <= 24:
                found.add(i)
        found.update(i for i in p if NUMBER_ONLY.fullmatch(lines[i].strip()))
    edges = [(k, i, side) for k, p in enumerate(pages) for side, part in (("head", p[:EDGE]), ("foot", p[-EDGE:])) for i in part if i not in found]
    groups: dict[tuple[str, str], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    keys: dict[str, list[str]] = {"head": [], "foot": []}
    for k, i, side in edges:
        text = _plain(lines[i])
        if len(text) >= 4:
            key = next((x for x in keys[side] if _alike(x, text)), None)
            if key is None:
                keys[side].append(text)
            groups[side, key or text][k].append(i)
    title = _title(lines, pages, found)
    for (side, text), by_page in groups.items():
        if len(by_page) < 2:
            continue
        for k, at in by_page.items():
            i = at[0] if side == "head" else at[-1]
            if k == 0 and side == "head" and len(at) == 1 and i == title:
                continue  # the title itself, of which the other pages' heads are copies
            found.add(i)
    if pages:
        # a head or foot that there is but one page to see on: it says again what the title says
        first = [i for i in pages[0] if i not in found]
        for n, i in enumerate(first[:EDGE]):
            for j in first[n + 1:n + 1 + EDGE]:
                a, b = _plain(lines[i]), _plain(lines[j])
                if len(a) >= 12 and (b == a or b.endswith(" " + a) or _alike(a, b)) and not lines[j].rstrip().endswith("."):
                    found.add(i)
                    title = j
                    break
            else:
                continue
            break
        if title is not None:
            whole = _plain(lines[title])
            names = whole.split()[-2:]
            for k, p in enumerate(pages):
                for i in p[-EDGE:] + (p[:2] if k else []):
                    if i != title and i not in found and not lines[i].rstrip().endswith((".", ",", ":")):
                        text = _plain(lines[i])
                        words = text.split()
                        if len(names) == 2 and words[:2] == names and len(words) <= 6 or len(text) >= 12 and whole.endswith(text):
                            found.add(i)
    # a short line atop a later page that neither ends a sentence nor stands alone is a head, though it is seen but once
    widths = sorted(len(lines[i]) for p in pages for i in p if len(lines[i]) <= 120)
    for p in pages[1:]:
        top = next((i for i in p if i not in found), None)
        if top is not None and top + 1 < len(lines) and lines[top + 1].strip() and not LABEL.match(lines[top]):
            line = lines[top].strip()
            if line[-1] not in ".,:;?!" + HYPHENS and len(line) < 0.7 * widths[len(widths) * 9 // 10] and not TAG.match(lines[top + 1]):
                found.add(top)
    return found


def _title(lines: list[str], pages: list[list[int]], found: set[int]) -> int | None:
    """The first page's last line ahead of the first blank line among its top lines."""
    if not pages:
        return None
    at = None
    for i in pages[0][:EDGE + 2]:
        if i not in found:
            at = i
        if i + 1 < len(lines) and not lines[i + 1].strip():
            break
    return at


class Lexicon:
    """Word and word-pair counts of the corpus and the channel."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.words, self.pairs = words, pairs
        self.total = max(1, sum(words.values()))
        self.after: Counter = Counter()
        for (a, _), n in pairs.items():
            self.after[a] += n
        self.longest = max((len(w) for w in words if len(w) <= WORD_LIMIT), default=0)
        self.blanked: dict[str, list[str]] | None = None
        self.known: dict[tuple[str, bool], list[tuple[str, float, tuple[int, ...]]]] = {}

    def candidates(self, seen: str, deep: bool = True) -> list[tuple[str, float, tuple[int, ...]]]:
        """(word, log probability that it is read as ``seen``, places in ``seen`` that differ) of corpus words, by up to two confusions, or
        by one other character."""
        if (seen, deep) in self.known:
            return self.known[seen, deep]
        found: dict[str, tuple[float, tuple[int, ...]]] = {}
        if len(seen) > 2 * self.longest:  # no confusion makes it so much longer than any word
            return []
        level = {seen: ()}
        # an unknown name is most likely a name, which its prior says: one confusion must do
        for depth in (1, 2) if deep else (1,):
            after: dict[str, tuple[int, ...]] = {}
            for text, places in level.items():
                for i in range(len(text)):
                    for n in (1, 2):
                        for true in PRINTED.get(text[i:i + n], ()) if i + n <= len(text) else ():
                            # lengths change, so a place is kept as the distance from the nearer end
                            new = text[:i] + true + text[i + n:]
                            if new not in level and new != seen:
                                after.setdefault(new, (*places, min(i, len(seen) - 1)))
            for new, places in after.items():
                s = new if new.isalpha() else shape(new)
                if (s in self.words or new in self.words) and new not in found:
                    found[new] = (depth * ERROR, places)
            if found:
                break
            level = after
        if deep and not found and len(seen) >= 5 and seen.isascii() and seen.isalpha():
            if self.blanked is None:
                self.blanked = defaultdict(list)
                for w in self.words:
                    if len(w) >= 5 and w.isalpha():
                        for i in range(len(w)):
                            self.blanked[w[:i] + "?" + w[i + 1:]].append(w)
            for i in range(len(seen)):
                for w in self.blanked.get(seen[:i] + "?" + seen[i + 1:], ()):
                    found.setdefault(w, (OTHER_ERROR, (i,)))
        out = [(w, p, at) for w, (p, at) in found.items()]
        if len(self.known) >= CANDIDATES:
            self.known.clear()
        self.known[seen, deep] = out
        return out

    def word(self, w: str) -> float:
        n = self.words.get(w)
        return math.log(n / self.total) if n else UNKNOWN

    def pair(self, a: str, b: str, alone: float) -> float:
        n, m = self.pairs.get((a, b), 0), self.after.get(a, 0)
        return math.log(PAIR_WEIGHT * n / m + (1 - PAIR_WEIGHT) * math.exp(alone)) if m else alone

    def decode(self, tokens: list[str]) -> list[tuple[str, tuple[int, ...]] | None]:
        """Viterbi over the candidates of each token; per token the word that was printed, with the places that differ, or None where it stands as read."""
        folded = [core(t)[1].lower() for t in tokens]
        options: list[list[tuple[str, str, float, tuple[int, ...]]]] = []
        doubt = False
        for t, seen in zip(tokens, folded):
            if not seen:
                options.append([("", t, math.log(0.01), ())])
                continue
            s = shape(seen)
            own, deep = self.word(s), True
            mixed = s != seen and any(c.isalpha() for c in seen)
            if own == UNKNOWN and core(t)[1][0].isupper() and core(t)[1].isalpha() and core(t)[1].isascii():
                own, deep = UNKNOWN_NAME, False
            row = [(s, "", own, ())]
            if s not in self.words or mixed:
                for w, p, at in self.candidates(seen, deep):
                    ws = shape(w)
                    row.append((ws, w, self.word(ws) + p, at))
                    doubt = True
            options.append(row)
        if not doubt:
            return [None] * len(tokens)
        best = [(0.0, -1, START)]
        trail = []
        for row in options:
            now = []
            for s, w, alone, at in row:
                channel = alone - (self.word(s) if s else alone)  # the part that isn't the word's own frequency
                base = self.word(s) if s in self.words else alone
                score, back = max((b[0] + (self.pair(b[2], s, base) if s in self.words else base) + (channel if s in self.words else 0.0), k)
                                  for k, b in enumerate(best))
                now.append((score, back, s or best[back][2]))
            trail.append(now)
            best = now
        k = max(range(len(best)), key=lambda x: best[x][0])
        out: list[tuple[str, tuple[int, ...]] | None] = []
        for row, now in zip(reversed(options), reversed(trail)):
            _, w, _, at = row[k]
            out.append((w, at) if w and at else None)
            k = now[k][1]
        return out[::-1]


ODD = re.compile(r"[^\W\d_][†!@|ﬁﬂﬀ+][^\W\d_]|[†ﬁﬂﬀ]")


def is_stray(tokens: list[str], k: int, lexicon: Lexicon) -> bool:
    """A mark on its own that no corpus text has beside the word before or behind it."""
    mark = tokens[k]
    if any(c.isalnum() for c in mark) or all(c in "-–—.,:;()[]{}\"'“”«»/&%…" for c in mark):
        return False
    word = lambda t: shape(core(t)[1]) or t
    before = word(tokens[k - 1]) if k else START
    behind = word(tokens[k + 1]) if k + 1 < len(tokens) else ""
    return (before, mark) not in lexicon.pairs and (mark, behind) not in lexicon.pairs


class Page:
    """What is wrong in one scanned text, and the text put right."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.lines = text.replace("\r", "").split("\n")
        self.furniture = furniture(self.lines)
        self.broken: dict[int, int] = {}
        self.misread: set[int] = set()
        self.fixed: dict[int, list[str]] = {}
        running = [i for i, x in enumerate(self.lines) if x.strip() and i not in self.furniture and not TAG.match(x)]
        tokens = {i: self.lines[i].split() for i in running}
        for n, i in enumerate(running):
            m = BROKEN.search(self.lines[i])
            if m:
                # the next line of running text: it begins in the middle of a word, so with a letter and not with a capital after small ones
                for j in running[n + 1:n + 1 + EDGE]:
                    first = self.lines[j].lstrip()[:1]
                    if (first.islower() or first and (m[1].isupper() or not first.isupper()) and first.isalnum() or first in "†!") and j not in self.broken.values():
                        if self._joins(m[1], tokens[j][0], lexicon) or j == running[n + 1]:
                            self.broken[i] = j
                            break
        heads = {j: i for i, j in self.broken.items()}
        for i in running:
            row = list(tokens[i])
            skip = 1 if i in heads else 0
            split = None
            if i in self.broken and row:
                a = row[-1].rstrip().rstrip(HYPHENS)
                b = tokens[self.broken[i]][0]
                if a + b.lower() not in lexicon.words and shape(core(f"{a}-{b}")[1]) in lexicon.words:
                    a += "-"
                row[-1], split = a + b, len(core(a)[1] if not a.endswith("-") else a.lstrip("([\"'“"))
            part = row[skip:]
            decoded = lexicon.decode(part)
            out = []
            for k, (t, d) in enumerate(zip(part, decoded)):
                joint = split is not None and k == len(part) - 1
                if d:
                    word, places = d
                    for at in places:
                        self.misread.add(self.broken[i] if joint and at >= split else i)
                    before, seen, after = core(t)
                    out.append(before + (word.capitalize() if seen[:1].isupper() and not seen.isupper() else word.upper() if seen.isupper() and len(seen) > 1 else word) + after)
                    continue
                if is_stray(part, k, lexicon):
                    self.misread.add(i)
                    continue
                odd = ODD.search(core(t)[1])
                if odd and shape(core(t)[1]) not in lexicon.words:
                    self.misread.add(self.broken[i] if joint and odd.start() >= split else i)
                out.append(t)
            self.fixed[i] = out

    @staticmethod
    def _joins(a: str, b: str, lexicon: Lexicon) -> bool:
        word = (a + core(b)[1]).lower()
        return word in lexicon.words or a[:1].isupper() or bool(lexicon.candidates(word))

    def damages(self) -> list[tuple[int, str]]:
        return ([(i + 1, "furniture") for i in sorted(self.furniture)] + [(i + 1, "broken_word") for i in sorted(self.broken)]
                + [(i + 1, "misread") for i in sorted(self.misread)])

    def text(self) -> str:
        """Paragraphs of one line each, without page tags and furniture; a paragraph goes on behind a page's end if the sentence does."""
        out: list[str] = []
        last, gap, turned = None, False, False
        for i, line in enumerate(self.lines):
            if not line.strip():
                gap = True
                continue
            if PAGE_TAG.fullmatch(line.strip()):
                turned = True
                continue
            if i in self.furniture:
                continue
            words = " ".join(self.fixed.get(i, line.split()))
            if not words:
                continue
            goes_on = last is not None and (last in self.broken or self.lines[last].rstrip()[-1:] not in ".:;?!") and not TAG.match(line)
            if goes_on and (line.lstrip()[0].islower() or line.lstrip()[0].isdigit() and (turned or not gap) or not gap and len(self.lines[last]) >= 50):
                out[-1] += " " + words
            else:
                out.append(words)
            last, gap, turned = i, False, False
        return "\n\n".join(out)


def _counts(batches: Iterator[pd.DataFrame], most: int = COUNTED) -> Iterator[pd.DataFrame]:
    """Per kind of text: documents, words and word pairs with their document frequencies; what ``most`` of them have been counted for goes on."""
    words: Counter = Counter()

    def rows() -> pd.DataFrame:
        found = pd.DataFrame([(s, a, b, n) for (s, a, b), n in words.items()], columns=["scanned", "a", "b", "n"])
        words.clear()
        return found

    for batch in batches:
        for name, text in zip(batch["filename"], batch["raw_text"]):
            scanned = is_scanned(name, text)
            words[scanned, "", ""] += 1
            seen = set()
            for line in text.split("\n"):
                if TAG.match(line):
                    line = TAG.sub("", line, count=1)
                last = START
                for token in line.split():
                    w = shape(core(token)[1]) or token
                    seen.add((w, ""))
                    seen.add((last, w))
                    last = w
            words.update((scanned, a, b) for a, b in seen)
            if len(words) >= most:
                yield rows()
    if words:
        yield rows()


_cache: dict[str, Lexicon] = {}


class ScanRepair:
    """Fits the corpus counts and applies them to the scanned texts of the same table."""

    def __init__(self, docs: DataFrame, least_share: float = 0.0005, least_docs: int = 3):
        spark = docs.sparkSession
        rows = docs.where("parsed_id is not null and raw_text is not null").select("parsed_id", "filename", "raw_text")
        # a document delivered more than once counts once; the texts of the others don't move for that
        again = cut(rows.groupBy("parsed_id").count().where("count > 1").select("parsed_id"))
        if not again.isEmpty():
            rows = rows.join(again, "parsed_id", "left_anti").unionByName(rows.join(again, "parsed_id", "left_semi").dropDuplicates(["parsed_id"]))
        self.rows = spread(rows)
        counts = cut(self.rows.mapInPandas(_counts, "scanned boolean, a string, b string, n bigint")
                     .groupBy("scanned", "a", "b").agg(F.sum("n").alias("n")))
        size = {r["scanned"]: r["n"] for r in counts.where("a = '' and b = ''").collect()}  # two rows at most
        clean = False if size.get(False) else True
        least = max(least_docs, math.ceil(least_share * size.get(clean, 0)))
        kept = counts.where((F.col("scanned") == clean) & (F.col("n") >= least) & (F.col("a") != "")).select("a", "b", "n").collect()
        self.lexicon = spark.sparkContext.broadcast(
            ({r["a"]: r["n"] for r in kept if not r["b"]}, {(r["a"], r["b"]): r["n"] for r in kept if r["b"]}))
        self.token = uuid.uuid4().hex

    def _apply(self, take, schema: str) -> DataFrame:
        shared, token = self.lexicon, self.token

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if token not in _cache:
                _cache.clear()
                _cache[token] = Lexicon(*shared.value)
            for batch in batches:
                for k in range(0, len(batch), APPLIED):
                    rows, some = [], batch.iloc[k:k + APPLIED]
                    for i, name, text in zip(some["parsed_id"], some["filename"], some["raw_text"]):
                        page = Page(text, _cache[token]) if is_scanned(name, text) else None
                        rows += take(i, text, page)
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(",")])

        return self.rows.mapInPandas(run, schema)

    def damages(self) -> DataFrame:
        """(parsed_id, line_no, damage) of scanned texts. Null texts are left out; a document delivered twice counts once."""
        return self._apply(lambda i, _, page: [(i, n, d) for n, d in page.damages()] if page else [],
                           "parsed_id bigint,line_no int,damage string")

    def repaired(self) -> DataFrame:
        """(parsed_id, scanned, clean_text): scanned texts as continuous paragraphs, others as they were."""
        return self._apply(lambda i, text, page: [(i, page is not None, page.text() if page else text)],
                           "parsed_id bigint,scanned boolean,clean_text string")
