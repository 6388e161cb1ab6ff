"""Exact top-k inner products by best-first search in M-trees.

*Metric.*  In a tree whose longest vector has norm M, a vector x stands at (x, sqrt(M^2 - |x|^2)) and a
query q at (q, 0): their Euclidean distance d fulfils d^2 = |q|^2 + M^2 - 2 q.x, so the largest inner
products are the nearest neighbours.

*Index.*  Vectors go to the nearest of a bounded number of sampled pivots, and a pivot's vectors are dealt
into trees of at most about ``TREE`` vectors, so no group grows with the data.  A tree is a table of pages.  An
entry of a page holds its routing vector, covering radius and distance to the page's own vector.

*Search.*  A queue holds pages by the best product they may contain.  An entry is skipped without
computing its distance when the stored distances already rule it out by the triangle inequality.  The search
ends when no page can beat the k-th result.  Bounds are rounded outwards and products are computed in
integers, so results are exact, ties included.

*Distribution.*  Queries meet the trees' roots in blocks; each query first searches its most promising tree,
then every tree whose root may still beat its k-th product.  Work at a tree is cut into blocks of queries.

*Lengths.*  A product needs vectors of one length, so a query meets the vectors of its own length.  Pivots have
the commonest length; the others are dealt to trees by length and a hash of the id.

Defined results: a vector that is NULL, empty, has a NULL or non-finite component, or has a NULL id takes no
part; rows with equal ids are all excluded for a query with that id, and
otherwise count as separate rows; fewer candidates than k give them all; products beyond 62 bits raise.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.llm.common import store

TREE = 8192
PAGE = 512
FANOUT = 32
MAX_PIVOTS = 512
ROOT_BLOCK = 1024
QUERY_BLOCK = 1024
EXACT = 1 << 50
_SLACK = 1e-9
NODES = "tree long, page int, leaf boolean, norm2 long, ids array<long>, vectors array<long>, radius array<double>, parent array<double>, child array<int>, least array<long>"


def usable(vector: Column) -> Column:
    """Not NULL or empty, every component finite."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """``(vec_id, v)``: usable vectors of any length, components ``floor(factor * x)``."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).filter(F.col("vec_id").isNotNull() & usable(F.col("x")))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * factor).cast("bigint")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def lifted(v: np.ndarray, norm2: int) -> np.ndarray:
    """Vectors with the extra coordinate of their tree."""
    rest = np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0).astype(float))
    return np.column_stack([v.astype(float), rest])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


class Builder:
    """Bulk loading of one tree."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        self.norm2 = int((v * v).sum(1).max())
        self.x = lifted(self.v, self.norm2)
        self.pages: list[dict] = []

    def build(self) -> list[dict]:
        rows = np.arange(len(self.ids))
        self._page(rows, rows[0])
        return self.pages

    def _page(self, rows: np.ndarray, own: int) -> int:
        """Write the page of ``rows`` around vector ``own``; returns its number."""
        number = len(self.pages)
        self.pages.append({})
        if len(rows) <= PAGE:
            entries, radius, child, least = rows, np.zeros(len(rows)), np.full(len(rows), -1), self.ids[rows]
        else:
            groups = self._groups(rows)
            entries = np.array([g[0] for g in groups])
            radius = np.array([distances(self.x[g], self.x[g[0]]).max() for g in groups])
            child = np.array([self._page(g, g[0]) for g in groups])
            least = np.array([self.ids[g].min() for g in groups])
        self.pages[number] = {"page": number, "leaf": child[0] < 0, "norm2": self.norm2, "ids": self.ids[entries], "vectors": self.v[entries].ravel(), "radius": radius,
                              "parent": distances(self.x[entries], self.x[own]), "child": child, "least": least}
        return number

    def _groups(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows by the nearest of spread-out routing vectors (each first in its group); equal vectors are
        cut into even runs."""
        n = min(FANOUT, -(-len(rows) // PAGE))
        seeds, near = [rows[0]], distances(self.x[rows], self.x[rows[0]])
        for _ in range(n - 1):
            seeds.append(rows[int(near.argmax())])
            near = np.minimum(near, distances(self.x[rows], self.x[seeds[-1]]))
        seeds = list(dict.fromkeys(seeds))
        if len(seeds) < 2 or len(np.unique(self.x[seeds], axis=0)) < 2:
            return np.array_split(rows, n)
        gap = np.stack([distances(self.x[rows], self.x[s]) for s in seeds])
        at = gap.argmin(0)
        groups = []
        for k, s in enumerate(seeds):
            own = rows[at == k]
            if len(own):
                groups.append(np.r_[s, own[own != s]] if s in own else own)
        return groups if len(groups) > 1 else np.array_split(rows, n)


class Tree:
    """Pages of one tree, ready for search."""

    def __init__(self, rows: list[dict]):
        self.norm2 = rows[0]["norm2"]
        self.pages = {}
        for r in rows:
            ids = np.array(r["ids"], np.int64)
            v = np.array(r["vectors"], np.int64).reshape(len(ids), -1)
            radius, parent, child, least = (np.array(r[c]) for c in ("radius", "parent", "child", "least"))
            self.pages[r["page"]] = (r["leaf"], ids, v.astype(float) if self.norm2 < EXACT else v, radius * (1 + _SLACK) + 1e-6, parent, child, -least)

    def best(self, own: int, q: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """Up to k ``(score, -id)`` that beat ``floor``, the k-th result known so far."""
        top: list[tuple[int, int]] = []
        q2 = int((q * q).sum())
        if q2 < EXACT and self.norm2 < EXACT:
            q = q.astype(float)  # sums of products stay below 2**52: doubles hold them exactly
        base = float(q2 + self.norm2)
        slack = _SLACK * base + 0.5
        bar = floor or (-math.inf, -math.inf)

        def bound(d: np.ndarray) -> np.ndarray:
            """Largest product at distance ``d`` or more."""
            return np.floor((base - np.maximum(d, 0.0) ** 2) / 2 + slack)

        heap: list[tuple] = [(-math.inf, 0, None)]
        while heap:
            top_bound, page, d_own = heapq.heappop(heap)
            if -top_bound < bar[0]:
                break
            leaf, ids, v, reach, parent, child, least = self.pages[page]
            live = slice(None)
            if d_own is not None:  # what the stored distances rule out is not computed
                limit = bound(np.abs(d_own - parent) - reach - 1e-6)
                live = np.flatnonzero((limit > bar[0]) | ((limit == bar[0]) & (least > bar[1])))
                if not len(live):
                    continue
            # gathering most of a page costs more than multiplying all of it
            products = (v @ q)[live] if d_own is None or 4 * len(live) > len(ids) else v[live] @ q
            if leaf:
                good = np.flatnonzero(products >= bar[0])
                for found in zip(map(int, products[good].tolist()), (-ids[live][good]).tolist(), strict=True):
                    if found[1] != -own and found > bar:
                        if len(top) < k:
                            heapq.heappush(top, found)
                        else:
                            heapq.heapreplace(top, found)
                        if len(top) == k:
                            bar = max(bar, top[0])
            else:
                d = np.sqrt(np.maximum(base - 2.0 * products, 0.0))
                limit = bound(d - reach[live] - 1e-6)
                near = np.flatnonzero((limit > bar[0]) | ((limit == bar[0]) & (least[live] > bar[1])))
                for high, to, far in zip(limit[near].tolist(), child[live][near].tolist(), d[near].tolist(), strict=True):
                    heapq.heappush(heap, (-high, to, far))
        return top


def build_index(vectors: DataFrame, tree: int = TREE) -> DataFrame:
    """Pages of all trees, written to the shared folder.  Pivots are the rows of the commonest length with
    the least hashes of their ids, one per ``tree`` rows and at most ``MAX_PIVOTS``."""
    common = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim, n = common[0] if common else (1, 0)
    wanted = min(MAX_PIVOTS, max(1, n // tree))
    pivots = np.array([r["v"] for r in vectors.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()], np.float64)
    if not len(pivots):
        pivots = np.zeros((1, dim))
    half = (pivots ** 2).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.array(pc.list_value_length(batch.column(1)), np.int64)
            usual = np.flatnonzero(length == dim)
            at = MAX_PIVOTS + length
            if len(usual):
                at[usual] = (matrix(batch.column(1).take(pa.array(usual)), len(usual)).astype(float) @ pivots.T - half).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["vec_id", "v", "cell"])

    placed = store(vectors.select("vec_id", "v").mapInArrow(nearest, "vec_id long, v array<long>, cell long"), "mtree-cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / tree).alias("trees"))
    dealt = placed.join(sizes, "cell").withColumn("tree", F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("vec_id"), F.col("trees")))

    def load(rows: pa.Table) -> pa.Table:
        pages = Builder(rows.column("vec_id").to_numpy(), matrix(rows.column("v"), rows.num_rows)).build()
        number = rows.column("tree")[0].as_py()
        return pa.Table.from_pylist([{"tree": number, **{c: p[c].tolist() if hasattr(p[c], "tolist") else p[c] for c in p}} for p in pages], schema=_NODES)

    return store(dealt.select("tree", "vec_id", "v").groupBy("tree").applyInArrow(load, NODES), "mtree-pages")


_NODES = pa.schema([("tree", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("norm2", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64())),
                    ("radius", pa.list_(pa.float64())), ("parent", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())), ("least", pa.list_(pa.int64()))])


def route(queries: DataFrame, roots: DataFrame, n_blocks: int, n_query_blocks: int, only_best: bool) -> DataFrame:
    """``(query_id, tree, bound)``: the trees whose root entries may beat the query's floor, or per block of
    roots the most promising tree only."""
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_query_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint")))).withColumn("dim", F.size("v"))
    right = roots.withColumn("rb", F.pmod(F.xxhash64("tree"), F.lit(n_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_query_blocks - 1).cast("bigint")))).withColumn("dim", (F.size("vectors") / F.size("ids")).cast("int"))

    def meet(qs: pa.Table, rs: pa.Table) -> pa.Table:
        ids, found = qs.column("query_id").to_numpy(), []
        q = matrix(qs.column("v"), len(ids)).astype(float)
        q2 = (q * q).sum(1)
        for r in rs.to_pylist() if len(ids) else ():
            v = np.array(r["vectors"], np.int64).reshape(len(r["ids"]), -1)
            x = lifted(v, r["norm2"])
            base = q2 + r["norm2"]
            d = np.sqrt(np.maximum(base[:, None] - 2 * (q @ v.T.astype(float)), 0.0))
            reach = np.array(r["radius"]) * (1 + _SLACK) + 1e-6 + _SLACK * np.sqrt(base)[:, None]
            high = np.floor((base[:, None] - np.maximum(d - reach, 0.0) ** 2) / 2 + _SLACK * base[:, None] + 0.5)
            found.append((r["tree"], high.max(1), np.where(high == high.max(1, keepdims=True), np.array(r["least"]), np.iinfo(np.int64).max).min(1), len(x)))
        if not found:
            return _ROUTES.empty_table()
        trees = np.array([f[0] for f in found])
        high, least = np.stack([f[1] for f in found], 1), np.stack([f[2] for f in found], 1)
        if only_best:
            row, col = np.arange(len(ids)), high.argmax(1)
        else:
            score = np.array([-math.inf if s is None else s for s in qs.column("floor_score").to_pylist()])[:, None]
            other = np.array([np.iinfo(np.int64).max if s is None else s for s in qs.column("floor_id").to_pylist()])[:, None]
            home = qs.column("home").to_numpy()[:, None]
            row, col = np.nonzero(((high > score) | ((high == score) & (least < other))) & (trees[None] != home))
        return pa.table([ids[row], trees[col], high[row, col]], schema=_ROUTES)

    return left.groupBy("qb", "rb", "dim").cogroup(right.groupBy("qb", "rb", "dim")).applyInArrow(meet, "query_id long, tree long, bound double")


_ROUTES = pa.schema([("query_id", pa.int64()), ("tree", pa.int64()), ("bound", pa.float64())])
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search(assigned: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: up to k results of each assigned tree that beat the query's floor."""
    load = assigned.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    left = assigned.join(load, "tree").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    right = pages.join(load, "tree").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")

    def look(qs: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if qs.num_rows and rows.num_rows:
            tree = Tree(rows.to_pylist())
            vectors = matrix(qs.column("v"), qs.num_rows)
            for own, q, score, other in zip(qs.column("query_id").to_pylist(), vectors, qs.column("floor_score").to_pylist(), qs.column("floor_id").to_pylist(), strict=True):
                floor = None if score is None else (score, -other)
                out += [(own, -i, s) for s, i in tree.best(own, q, k, floor)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=_HITS)

    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(look, "query_id long, vec_id long, score long")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, tree: int = TREE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for integer ``vectors`` ``(vec_id, v)`` and ``queries``
    ``(query_id, v)``."""
    vectors = store(vectors, "mtree-vectors")
    high = vectors.select(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    if high >= 2.0 ** 61:
        raise ValueError("inner products do not fit 62 bits")
    pages = build_index(vectors, tree)
    roots = pages.filter("page = 0").select("tree", "norm2", "ids", "vectors", "radius", "least")
    n_blocks = -(-max(1, roots.count()) // ROOT_BLOCK)
    queries = store(queries.select("query_id", "v"), "mtree-queries")
    n_query_blocks = -(-max(1, queries.count()) // QUERY_BLOCK)
    plain = queries.select("query_id", "v", F.lit(None).cast("bigint").alias("floor_score"), F.lit(None).cast("bigint").alias("floor_id"))
    home = route(plain, roots, n_blocks, n_query_blocks, True).groupBy("query_id").agg(F.max_by("tree", F.struct("bound", F.col("tree"))).alias("tree"))
    first = store(home.join(plain, "query_id"), "mtree-home")
    near = store(ranked(search(first, pages, k), k), "mtree-near")
    floor = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("s"), F.col("vec_id").alias("i"))
    known = first.join(floor, "query_id", "left").select("query_id", "v", F.col("tree").alias("home"), F.col("s").alias("floor_score"), F.col("i").alias("floor_id"))
    rest = route(known, roots, n_blocks, n_query_blocks, False).select("query_id", "tree").join(known.drop("home"), "query_id")
    far = search(store(rest, "mtree-rest"), pages, k)
    return ranked(near.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
