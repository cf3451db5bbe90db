"""Most similar vectors for every vector.

Method: NN-descent. Every vector keeps its ``degree`` best neighbours so far. A round joins each vector's neighbours (in both directions) with
one another, since a neighbour of a neighbour is likely a neighbour; only pairs with a newly found edge are compared. Rounds end when
few edges change. The first edges come from random-projection trees: the vectors of one leaf are compared with one another.

A round runs on cells, the leaves of the first tree: the neighbour lists of a cell's vectors and the vectors they name meet in one group, each
vector once per cell. Cells are cut by hash above ``CELL`` vectors, and a vector named by very many others has its list of those cut into parts
that are joined separately, so no group grows with the collection. Equal vectors are one class, represented once.

The trees' planes and thresholds are fitted on at most ``SAMPLE`` vectors; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, parallelism

SAMPLE = 20_000
CELL = 1024
EDGE = "v bigint, u bigint, sim double, v_cell bigint, u_cell bigint"
HUB = 8  # a vector named by more than this many times ``degree`` others has its list cut into parts


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): vectors of ``dim`` finite values that aren't all zero, one per id; vec is the float32 bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, e in zip(batch["id"], batch["vec"]):
                if len(e) == dim:
                    x = np.asarray(e, np.float32)
                    if np.isfinite(x).all() and x.any():
                        rows.append((i, x.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "vec"])

    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInPandas(pack, f"id {kind}, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(vecs) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float32).reshape(len(vecs), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Random-projection trees: one plane per level, one threshold per node, the median of the sample's vectors there; nodes that hold
    too few of the sample split at the sample's mean."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1] if len(sample) else 1
        self.planes = rng.standard_normal((trees, depth, dim))
        mean = sample.mean(0) if len(sample) else np.zeros(dim)
        self.default = self.planes @ mean
        self.thresholds: list[list[np.ndarray]] = []
        for t in range(trees):
            node, levels = np.zeros(len(sample), np.int64), []
            for d in range(depth):
                # bounded by the sample: deeper levels have no table
                if 1 << d > len(sample):
                    break
                p = sample @ self.planes[t, d]
                table = np.full(1 << d, self.default[t, d])
                order = np.argsort(node, kind="stable")
                borders = np.searchsorted(node[order], np.arange((1 << d) + 1))
                for k in range(1 << d):
                    inside = order[borders[k]:borders[k + 1]]
                    if len(inside) >= 8:
                        table[k] = np.median(p[inside])
                levels.append(table)
                node = 2 * node + (p > table[node])
            self.thresholds.append(levels)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for d in range(self.planes.shape[1]):
            p = x @ self.planes[tree, d]
            levels = self.thresholds[tree]
            node = 2 * node + (p > (levels[d][node] if d < len(levels) else self.default[tree, d]))
        return node


def _best(v: np.ndarray, u: np.ndarray, sim: np.ndarray, k: int) -> pd.DataFrame:
    """The k best distinct u of each v."""
    order = np.lexsort((u, -sim, v))
    v, u, sim = v[order], u[order], sim[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    v, u, sim = v[fresh], u[fresh], sim[fresh]
    start = np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1] if len(v) else np.zeros(0, int)
    rank = np.arange(len(v)) - np.repeat(start, np.diff(np.r_[start, len(v)]))
    keep = rank < k
    return pd.DataFrame({"v": v[keep], "u": u[keep], "sim": sim[keep]})


def _leaf_join(degree: int):
    """All vectors of one leaf compared with one another."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, cells, x = group["v"].to_numpy(), group["cell"].to_numpy(), _matrix(group["vec"].tolist())
        k = min(degree, len(ids) - 1)
        if k < 1:
            return _edges(ids, cells, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return _edges(ids, cells, np.repeat(np.arange(len(ids)), k), near.ravel(), np.take_along_axis(s, near, 1).ravel())

    return run


def _edges(ids: np.ndarray, cells: np.ndarray, v: np.ndarray, u: np.ndarray, sim: np.ndarray) -> pd.DataFrame:
    """Edges between places of ``ids`` as rows."""
    return pd.DataFrame({"v": ids[v], "u": ids[u], "sim": sim, "v_cell": cells[v], "u_cell": cells[u]})


def _local_join(degree: int):
    """The neighbour lists of one cell: members of a list compared with one another; what beats a member's worst neighbour is passed on."""

    def run(lists: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        ids = vecs["w"].to_numpy()
        order = np.argsort(ids)
        ids, worst, cells = ids[order], vecs["worst"].to_numpy()[order], vecs["cell"].to_numpy()[order]
        x = _matrix([vecs["vec"].iat[k] for k in order])
        owner, place, fresh = lists["v"].to_numpy(), np.searchsorted(ids, lists["u"].to_numpy()), lists["fresh"].to_numpy()
        # an edge that goes both ways stands twice in a list: the fresh one first, and only the first stays
        by = np.lexsort((~fresh, place, owner))
        owner, place, fresh = owner[by], place[by], fresh[by]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])]
        owner, place, fresh = owner[once], place[once], fresh[once]
        borders = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)]
        got = []
        for a, b in zip(borders[:-1], borders[1:]):
            m, f = place[a:b], fresh[a:b]
            if b - a < 2 or not f.any():
                continue
            new = m[f]
            s = x[new] @ x[m].T
            differ = new[:, None] != m[None, :]
            i, j = np.nonzero(differ & (s > worst[new][:, None]))
            got.append((new[i], m[j], s[i, j]))
            i, j = np.nonzero(differ & (s > worst[m][None, :]))
            got.append((m[j], new[i], s[i, j]))
        if not got:
            none = np.zeros(0, int)
            return _edges(ids, cells, none, none, np.zeros(0))
        out = _best(*(np.concatenate(c) for c in zip(*got)), degree)
        return _edges(ids, cells, out["v"].to_numpy(), out["u"].to_numpy(), out["sim"].to_numpy())

    return run


def _top(edges: DataFrame, degree: int) -> DataFrame:
    rank = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return edges.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= degree).drop("rank")


class Graph:
    """The neighbour graph of a collection: classes (v, vec, cell), members (id, v) and edges (v, u, sim)."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64, degree: int = 48, trees: int = 4,
                 rounds: int = 10, least_change: float = 0.002):
        spark = vectors.sparkSession
        rows = cut(usable(vectors, id_col, vec_col, dim))
        numbered = rows.groupBy("vec").agg(F.count("*").alias("members"))
        heads = cut(numbered.withColumn("v", F.monotonically_increasing_id()))
        self.members = rows.join(heads.select("vec", "v"), "vec").select("id", "v")
        n = heads.count()
        self.size = n
        depth = max(0, math.ceil(math.log2(max(1, n) / CELL)))
        fraction = min(1.0, 1.2 * SAMPLE / max(1, n))
        sample = heads.sample(fraction, seed=11).limit(SAMPLE).select("vec").collect() if n else []
        forest = spark.sparkContext.broadcast(
            Forest(_matrix([r["vec"] for r in sample]) if sample else np.zeros((0, dim)), trees, depth))

        def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["vec"].tolist())
                    codes = np.stack([forest.value.leaves(x, t) for t in range(trees)], 1)
                    yield batch.assign(leaves=list(codes))

        placed = heads.select("v", "vec").mapInPandas(leaves, "v bigint, vec binary, leaves array<bigint>")
        # a leaf above the cell size is cut by hash; how many parts it needs is counted first
        leaf = placed.select("v", "vec", F.posexplode("leaves").alias("tree", "leaf"))
        parts = leaf.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
        leaf = cut(leaf.join(parts, ["tree", "leaf"])
                   .withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).select("v", "vec", "tree", "leaf", "part"))
        self.heads = cut(leaf.where("tree = 0").select("v", "vec", F.xxhash64("leaf", "part").alias("cell")))
        first = (leaf.join(self.heads.select("v", "cell"), "v").groupBy("tree", "leaf", "part").applyInPandas(_leaf_join(degree), EDGE))
        edges = cut(self._merged(first.withColumn("fresh", F.lit(True)), degree))
        changed, total = n * degree, n * degree
        for _ in range(rounds if n > 2 else 0):
            edges = self._round(edges, degree, changed < 0.2 * total)
            changed = edges.where("fresh").count()
            if changed < least_change * total:
                break
        self.edges = edges.select("v", "u", "sim")

    @staticmethod
    def _merged(edges: DataFrame, degree: int) -> DataFrame:
        """The best edges of each vector, one exchange for both steps. An edge known before isn't fresh."""
        n = parallelism(edges.sparkSession)
        one = (edges.repartition(n, "v").groupBy("v", "u").agg(
            F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.first("v_cell").alias("v_cell"), F.first("u_cell").alias("u_cell")))
        return _top(one, degree)

    def _round(self, edges: DataFrame, degree: int, few: bool) -> DataFrame:
        """Joins the neighbours of each vector with one another. With ``few`` fresh edges only the lists that hold one are moved."""
        lists = (edges.select(F.col("v_cell").alias("home"), "v", "u", "fresh")
                 .unionByName(edges.select(F.col("u_cell").alias("home"), F.col("u").alias("v"), F.col("v").alias("u"), "fresh")))
        hubs = edges.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > HUB * degree)
        hubs = cut(hubs.select(F.col("u").alias("v"), F.ceil(F.col("n") / (2 * degree)).cast("int").alias("parts")))
        if not hubs.isEmpty():
            # those it names go to every part of a hub, each that names it to one part; a part is a group of its own
            back = ~F.col("own")
            tagged = (edges.select(F.col("v_cell").alias("home"), "v", "u", "fresh", F.lit(True).alias("own"))
                      .unionByName(edges.select(F.col("u_cell").alias("home"), F.col("u").alias("v"), F.col("v").alias("u"), "fresh", F.lit(False).alias("own")))
                      .join(hubs, "v", "left"))
            part = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).when(
                back, F.array(F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
            lists = (tagged.withColumn("part", F.explode(part)).select(
                F.when(F.col("part") < 0, F.col("home")).otherwise(F.xxhash64("home", "v", "part")).alias("home"), "v", "u", "fresh"))
        if few:
            touched = edges.where("fresh").select(F.explode(F.array("v", "u")).alias("v")).distinct()
            lists = lists.join(touched, "v", "left_semi")
        worst = edges.groupBy("v").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
        vecs = self.heads.join(worst, "v", "left").fillna(-2.0, ["worst"]).withColumnRenamed("v", "w")
        needed = (lists.select(F.col("home").alias("at"), F.col("u").alias("w")).distinct().join(vecs, "w").select("at", "w", "vec", "worst", "cell"))
        found = lists.groupBy("home").cogroup(needed.groupBy("at")).applyInPandas(_local_join(degree), EDGE)
        return cut(self._merged(edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), degree))

    def nearest(self, k: int = 5) -> DataFrame:
        """(id, other_id, similarity, rank): the k nearest others of every id by cosine rounded to 6 places, ties to the smaller id."""
        members = cut(self.members)
        # k + 1 of a class suffice for anyone: its smallest ids come first among equals
        few = (_smallest(members, k + 1))
        near = (self.edges.unionByName(self.heads.select("v", F.col("v").alias("u"), F.lit(1.0).alias("sim")))
                .join(few.withColumnRenamed("v", "u"), "u")
                .select("v", F.explode("ids").alias("other"), F.round("sim", 6).alias("sim")))
        rank = Window.partitionBy("v").orderBy(F.desc("sim"), "other")
        best = (near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k + 1).groupBy("v")
                .agg(F.sort_array(F.collect_list(F.struct("rank", "other", "sim"))).alias("near")))
        mine = members.join(best, "v").select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
        return mine.select("id", F.posexplode("near").alias("p", "x")).select(
            "id", F.col("x.other").alias("other_id"), F.col("x.sim").alias("similarity"), (F.col("p") + 1).alias("rank"))

    def _components(self, both: DataFrame) -> DataFrame:
        """(v): the smallest vector of each connected part of the graph. Labels spread to neighbours and jump to their label's label until none changes."""
        label = cut(self.heads.select("v", F.col("v").alias("c")))
        while True:
            near = both.join(label.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("n"))
            least = cut(label.join(near, "v", "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
            if least.where("moved").isEmpty():
                return label.where("v = c").select("v")
            label = cut(least.select("v", F.col("c").alias("p")).join(least.select(F.col("v").alias("p"), "c"), "p").select("v", "c"))

    def search(self, queries: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, beam: int = 64, others_only: bool = False) -> DataFrame:
        """(query_id, other_id, similarity, rank): greedy graph search. Each query keeps its ``beam`` best vectors so far and, in each step, visits the
        neighbours of those not visited from yet, until no query has any. The first vectors are a few spread over the collection and one of each
        connected part of the graph. With ``others_only`` the queries are of the collection, and none is its own neighbour."""
        asked = cut(usable(queries, id_col, vec_col, dim).select(F.col("id").alias("q"), F.col("vec").alias("q_vec")))
        both = cut(self.edges.select("v", "u").unionByName(self.edges.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct())
        spread_out = self.heads.select("v").orderBy(F.xxhash64("v")).limit(beam)
        starts = cut(spread_out.unionByName(self._components(both)).distinct().join(self.heads.select("v", "vec"), "v"))
        pairs = asked.crossJoin(starts)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    sim = (_matrix(batch["q_vec"].tolist()) * _matrix(batch["vec"].tolist())).sum(1)
                    yield pd.DataFrame({"q": batch["q"], "v": batch["v"], "sim": sim})

        kind = asked.schema["q"].dataType.simpleString()
        schema = f"q {kind}, v bigint, sim double"
        rank = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
        held = cut(pairs.mapInPandas(score, schema).withColumn("done", F.lit(False)))
        # a vector that left a beam never comes back, as beams only get better: so this ends
        while not held.where("not done").isEmpty():
            hops = (held.where("not done").select("q", "v").join(both, "v").select("q", F.col("u").alias("v")).distinct()
                    .join(held.select("q", "v"), ["q", "v"], "left_anti")
                    .join(self.heads.select("v", "vec"), "v").join(asked, "q"))
            new = hops.mapInPandas(score, schema).withColumn("done", F.lit(False))
            held = cut(held.withColumn("done", F.lit(True)).unionByName(new).withColumn("r", F.row_number().over(rank))
                       .where(F.col("r") <= beam).drop("r"))
        few = _smallest(cut(self.members), k + 1)
        near = held.join(few, "v").select("q", F.explode("ids").alias("other_id"), F.round("sim", 6).alias("similarity"))
        if others_only:
            near = near.where("q <> other_id")
        order = Window.partitionBy("q").orderBy(F.desc("similarity"), "other_id")
        return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select(F.col("q").alias("query_id"), "other_id", "similarity", "rank"))


def _smallest(members: DataFrame, k: int) -> DataFrame:
    """(v, ids): the k smallest ids of each class; ranks are cut before and after the shuffle."""
    order = Window.partitionBy("v").orderBy("id")
    return (members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def nearest_pairs(vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, **parameters) -> DataFrame:
    """(id, other_id): the smaller id first, where one is among the k nearest of the other."""
    near = Graph(vectors, id_col, vec_col, dim, **parameters).nearest(k)
    return near.select(F.least("id", "other_id").alias(id_col), F.greatest("id", "other_id").alias(f"other_{id_col}")).distinct()
