"""Filling fixed-capacity containers with items.

Method: Martello-Toth reduction, then best fit. Sizes are whole numbers up to the capacity, so the whole instance is a histogram of at most
``capacity`` counts, whatever the number of items. On it, sets that dominate all others (an item with the one that fills its container
exactly, an item with which at most one or two others fit) are fixed for all items of these sizes at once; the remainder is packed by
best fit, largest first, again all items of one size and all containers of one residual at a time. The result is a list of segments per size
(item ranks -> container numbers); documents then take their container from their rank within their size. Ranks are counted per (size, salt),
so a size shared by any part of all rows is spread over tasks.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the published split pattern of the byte-level vocabulary; fixed value
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_PER_RANKING = 100_000

Segment = tuple[int, int, int, int]  # first rank, number of items, first container, items per container

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): null and empty texts have none; a repeated id counts once, with its largest text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "tokens": [len(encode(t)) for t in batch["text"]]})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (spread(rows).mapInPandas(run, f"id {kind}, tokens bigint").groupBy("id").agg(F.max("tokens").alias("tokens"))
            .withColumnRenamed("id", id_col))


class Plan:
    """Containers for a histogram {size: count}, sizes from 1 to the capacity."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.containers = capacity, 0
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.used: dict[int, int] = defaultdict(int)
        self.segments: dict[int, list[Segment]] = defaultdict(list)
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, size: int, items: int, first: int, each: int) -> None:
        """The next ``items`` of a size go to the containers from ``first`` on, ``each`` to one."""
        self.segments[size].append((self.used[size], items, first, each))
        self.used[size] += items
        self.left[size] -= items
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def _fix(self, sizes: list[int], times: int) -> None:
        for s in set(sizes):
            self._take(s, times * sizes.count(s), self.containers, sizes.count(s))
        self.containers += times
        self.fixed += times

    def _largest(self, limit: int, without: int) -> int:
        """Largest size up to ``limit``, with one item of size ``without`` away; 0 if there is none."""
        k = bisect_right(self.sizes, limit) - 1
        if k >= 0 and self.sizes[k] == without and self.left[without] == 1:
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def _smallest(self, n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n, self.left[s] - (s == without))
            if len(out) >= n:
                break
        return out[:n]

    def _best_pair(self, room: int, without: int) -> int:
        """Largest sum of two items that fit into ``room``."""
        best, lo, hi = 0, 0, bisect_right(self.sizes, room) - 1
        have = lambda s: self.left[s] - (s == without)
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > room or have(b) < 1:
                hi -= 1
            elif have(a) < 1 or a == b and have(a) < 2:
                lo += 1
            else:
                best = max(best, a + b)
                lo += 1
        return best

    def _reduce(self) -> None:
        """Dominance: of all sets with an item, one that no other betters is fixed, for as many items as there are."""
        for size in sorted(self.left, reverse=True):
            while size in self.left:
                room = self.capacity - size
                other = self._largest(room, size)
                if not other:
                    # nothing fits beside it
                    self._fix([size], self.left[size])
                    break
                few = self._smallest(3, size)
                dominant = other == room or len(few) > 1 and sum(few[:2]) > room or len(few) == 1
                if not dominant and sum(few) > room:
                    dominant = other >= self._best_pair(room, size)
                if not dominant:
                    break
                pair = [size, other]
                self._fix(pair, self.left[size] // 2 if size == other else min(self.left[size], self.left[other]))

    def _best_fit(self) -> None:
        """Best fit, largest first: items of a size go to the fullest containers that hold them, then to new ones."""
        residuals: list[int] = []
        ranges: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in ranges:
                    insort(residuals, room)
                    ranges[room] = []
                ranges[room].append((first, n))

        for size in sorted(self.left, reverse=True):
            k = bisect_left(residuals, size)
            while size in self.left and k < len(residuals):
                room = residuals[k]
                each, runs = room // size, ranges[room]
                moved = []
                while runs and size in self.left:
                    first, n = runs.pop()
                    whole = min(n, self.left[size] // each)
                    if whole:
                        self._take(size, whole * each, first, each)
                        moved.append((room - each * size, first, whole))
                    if whole < n:
                        rest = self.left.get(size, 0)
                        if rest and rest < each:
                            self._take(size, rest, first + whole, rest)
                            moved.append((room - rest * size, first + whole, 1))
                            whole += 1
                        if n > whole:
                            runs.append((first + whole, n - whole))
                            if size not in self.left:
                                break
                if not runs:
                    del ranges[room]
                    residuals.pop(k)
                else:
                    k += 1
                for m in moved:
                    put(*m)
                k = bisect_left(residuals, size) if size in self.left else k
            if size in self.left:
                each, n = self.capacity // size, self.left[size]
                whole = n // each
                if whole:
                    self._take(size, whole * each, self.containers, each)
                    put(self.capacity - each * size, self.containers, whole)
                    self.containers += whole
                if n % each:
                    self._take(size, n % each, self.containers, n % each)
                    put(self.capacity - n % each * size, self.containers, 1)
                    self.containers += 1


def pack(sizes: DataFrame, capacity: int = 2048, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(doc_id, part, size, container): the container of every id. An item above the capacity is cut into parts of the capacity and a remainder, everything else
    is whole (part 0). Items of no size go to the containers in turn. Sizes that are null or negative count as 0; a repeated id counts once, with its largest size."""
    if not 0 < capacity <= 1 << 20:
        raise ValueError("capacity must be between 1 and 2**20")
    spark = sizes.sparkSession
    items = (sizes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.greatest(F.lit(0), F.coalesce(F.max(size_col), F.lit(0))).cast("bigint").alias("total")))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / capacity) - 1).cast("int")
    parts = cut(items.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
                .select("id", "part", F.least(F.lit(capacity), F.col("total") - F.col("part") * capacity).cast("int").alias("size")))
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    plan = Plan({s: n for s, n in counts.items() if s}, capacity)
    salts = max(1, math.ceil(max(counts.values(), default=1) / ROWS_PER_RANKING))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
               .select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("size", "salt").orderBy("id", "part")
    ranked = (salted.withColumn("inside", F.row_number().over(inside)).join(offsets, ["size", "salt"])
              .select("id", "part", "size", (F.col("inside") - 1 + F.col("offset")).alias("rank")))
    tables = {}
    for s, segments in plan.segments.items():
        tables[s] = np.array(sorted(segments), np.int64)
    shared, containers = spark.sparkContext.broadcast(tables), max(1, plan.containers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            container = rank % containers  # of items of no size
            for s in np.unique(size[size > 0]):
                at, t = np.flatnonzero(size == s), shared.value[int(s)]
                k = np.searchsorted(t[:, 0], rank[at], "right") - 1
                container[at] = t[k, 2] + (rank[at] - t[k, 0]) // t[k, 3]
            yield batch.assign(container=container)[["id", "part", "size", "container"]]

    kind = parts.schema["id"].dataType.simpleString()
    return (ranked.mapInPandas(place, f"id {kind}, part int, size int, container bigint")
            .withColumnsRenamed({"id": id_col, "size": size_col}))


def containers(packed: DataFrame, capacity: int = 2048, size_col: str = "tokens") -> DataFrame:
    """(container, items, filled, unused) of a packing."""
    return (packed.groupBy("container").agg(F.count("*").alias("items"), F.sum(size_col).alias("filled"))
            .withColumn("unused", F.lit(capacity) - F.col("filled")))
