"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. *Targets.*  Source weights share all words; a target stops at ``max_repeats`` times its source's size
   and the excess is shared again.
2. *Blocks.*  A seeded draw per document deals each source into blocks of about ``BLOCK_ROWS`` documents, however
   large it is.  Whole passes take every block; the last pass takes permuted blocks while they fit, then
   single documents of the next block (``fill_block``), then single documents of any block, larger size
   classes first, until none that may be repeated fits (``fill_rest``).  So a source's words miss its target by
   less than its smallest document with a repeat left, at every size.  Sums per block are all that is
   looked at on the way, so a hot source is just more blocks.
3. *Splitting tree.*  The blocks to take are exact quotas per source.  A node of the tree draws, from the
   multivariate hypergeometric distribution, how many blocks of each source go to its left half of the
   output shards; the rest goes right.  Nodes are seeded by their place, so tasks expand the
   subtrees of their own shards without talking to each other.
4. *Shuffle.*  A shard takes disjoint runs of each source's permuted blocks and orders its documents by a
   second draw.

All draws are functions of the seed and the row, so reruns and retried tasks agree.  The table of sources
(at most ``MAX_SOURCES`` names and sizes, checked) is the only thing that reaches the driver.

Defined results: a NULL source is a source of its own, last in order; a NULL text has size 0; rows of
size 0 are taken as often as their block; rows with equal source, id and text are decided together and
never taken more than ``max_repeats`` times each; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import ordinal, running_sum
from pointlake.llm.common import n_words, store

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
MAX_SOURCES = 100_000
BLOCK_ROWS = 1000
SHARD_WORDS = 5_000_000
#: Takes of a block's walk that are chosen again first; doubled until the room is full or all are.
CHOICE = 32
#: Sums told apart by the choice (all of them, if the room has no more words).
CELLS = 1 << 16
_SPAN = 1 << 31


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Words to take from each source."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _draw(seed: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(_SPAN))


@dataclass(frozen=True)
class Mix:
    """``units``: the distinct (source, id, text) rows with size and ``takes``, an array of (pass, shard)."""

    units: DataFrame
    n_shards: int


def sized(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row what the plan needs: id, hash of the text, source and size."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("k64"),
                     F.col(f"`{source}`").cast("string").alias("src"), n_words(F.col(f"`{text}`")).alias("size"))


def source_table(rows: DataFrame, weights: Sequence[float], max_repeats: int) -> pd.DataFrame:
    """Number, name, rows, size and target of each source, by code point with NULL last."""
    found = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    sizes = [r["total"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_repeats)
    return pd.DataFrame({"sid": range(len(found)), "src": [r["src"] for r in found], "n": [r["n"] for r in found], "source_size": sizes, "target": goal})


def best_subset(weights: Sequence[int], room: int) -> list[int]:
    """Places of items whose weights add up to the most that ``room`` holds.  Sums are kept in up to ``CELLS``
    cells of equal width, the largest of each; with a width of one (a room below ``CELLS``) no sum is lost."""
    width = room // CELLS + 1
    best = np.full(room // width + 1, -1, np.int64)
    best[0] = 0
    changed = []
    for w in weights:
        sums = best[best >= 0] + w
        sums = sums[sums <= room]
        cells = sums // width  # ascending, so the last of equal cells is the largest sum
        new = best.copy()
        new[cells] = np.maximum(best[cells], sums)
        changed.append(np.packbits(new > best))
        best = new
    total, chosen = int(best.max()), []
    for k in range(len(weights) - 1, -1, -1):
        cell = total // width
        if changed[k][cell >> 3] >> (7 - (cell & 7)) & 1:
            chosen.append(k)
            total -= weights[k]
    return chosen


def fill_block(weights: Sequence[int], room: int, copies: int) -> np.ndarray:
    """How often each document of a block is taken: walks in the order of the draws, up to ``copies``, past
    documents that do not fit; then the last takes of the walk are undone (twice as many each time, until the
    room is full or all were) and chosen again as a whole among all that is left.  Nothing left fits."""
    taken, free = [], []
    left = room
    for _ in range(copies):
        for k, w in enumerate(weights):
            if 0 < w <= left:
                taken.append(k)
                left -= w
            elif 0 < w <= room:
                free.append(k)
    result, undone, cut = taken, CHOICE, len(taken)
    while left and cut:
        cut = max(0, len(taken) - undone)
        undone *= 2
        space = room - sum(weights[k] for k in taken[:cut])
        items = [k for k in taken[cut:] + free if weights[k] <= space]
        picked = set(best_subset([weights[k] for k in items], space))
        over = space - sum(weights[items[i]] for i in picked)
        for i, k in enumerate(items):
            if i not in picked and weights[k] <= over:
                picked.add(i)
                over -= weights[k]
        if over < left:
            left, result = over, taken[:cut] + [items[i] for i in picked]
    times = np.zeros(len(weights), np.int64)
    np.add.at(times, np.array(result, np.int64), 1)
    return times


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """How often documents of a source's next block are taken once more."""
    pdf = pdf.sort_values(["u", "id", "k64"]).reset_index(drop=True)
    times = fill_block(pdf["weight"].tolist(), int(pdf["room"].iloc[0]), int(pdf["copies"].iloc[0]))
    return pdf.assign(times=times, used=times * pdf["weight"])[times > 0][["sid", "block", "id", "k64", "times", "used"]]


def last_pass(units: DataFrame, named: DataFrame, max_repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with the number of extra passes over the whole block (``whole``) and whether single documents
    are taken besides (``part``), and these documents with their ``times``."""
    sources = F.broadcast(named.select("sid", "full", F.round("rest").cast("bigint").alias("room")))  # bounded by MAX_SOURCES
    by_block = units.groupBy("sid", "block").agg(F.sum("weight").alias("words")).join(sources, "sid").withColumn("place", _draw(seed + 1, "sid", "block"))
    blocks = running_sum(store(by_block, "mix-sums"), ["sid"], ["place", "block"], F.shiftright("place", 15), before=F.col("words"))
    fits = F.col("before") + F.col("words") <= F.col("room")
    again = F.col("full") < max_repeats
    blocks = store(blocks.select("sid", "block", "words", "full", (again & fits).cast("bigint").alias("whole"),
                                 (again & ~fits & (F.col("before") < F.col("room"))).alias("next"), (F.col("room") - F.col("before")).alias("space")), "mix-blocks")
    last = blocks.filter("next").select("sid", "block", F.col("space").alias("room"), (max_repeats - F.col("full")).alias("copies"))
    filled = units.join(F.broadcast(last), ["sid", "block"]).select("sid", "block", "id", "k64", "u", "weight", "room", "copies")  # a block a source
    chosen = store(filled.groupBy("sid").applyInPandas(_fill, f"sid bigint, block bigint, id {units.schema['id'].dataType.simpleString()}, k64 bigint, times bigint, used bigint"), "mix-chosen")
    chosen = fill_rest(units, blocks, chosen, sources, max_repeats)
    part = chosen.select("sid", "block").distinct().withColumn("part", F.lit(True))
    return blocks.join(part, ["sid", "block"], "left").select("sid", "block", "full", "whole", F.coalesce("part", F.lit(False)).alias("part")), chosen.drop("used")


def fill_rest(units: DataFrame, blocks: DataFrame, chosen: DataFrame, sources: DataFrame, max_repeats: int) -> DataFrame:
    """``chosen`` with more single documents of any block until none that fits may be repeated.  A round takes the
    documents that fit, larger powers of two first, as long as their running sum fits.  After it either all of
    them were taken or the room is at most 3/4 of what it was, so rounds number about the logarithm of the
    room; mostly the room is empty before the first."""
    key = ["sid", "block", "id", "k64"]
    while True:
        used = blocks.select("sid", (F.col("words") * F.col("whole")).alias("used")).unionByName(chosen.select("sid", "used")).groupBy("sid").agg(F.sum("used").alias("used"))
        rooms = store(used.join(sources, "sid").select("sid", (F.col("room") - F.col("used")).alias("room")).filter("room > 0"), "mix-rooms")
        if rooms.isEmpty():
            return chosen
        fit = units.join(F.broadcast(rooms), "sid").filter((F.col("weight") > 0) & (F.col("weight") <= F.col("room"))).select(*key, "u", "weight", "room")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key]
        known = fit.join(blocks.select("sid", "block", "full", "whole"), ["sid", "block"]).alias("a").join(chosen.alias("c"), same, "left")
        left = known.filter(F.col("full") + F.col("whole") + F.coalesce("times", F.lit(0)) < max_repeats).select("a.*")
        bin_ = (63 - F.floor(F.log2("weight"))) * 65536 + F.shiftright("u", 15)
        run = running_sum(store(left.withColumn("bin", bin_), "mix-left"), ["sid"], ["bin", "u", "id", "k64"], F.col("bin"), before=F.col("weight"))
        more = store(run.filter(F.col("before") + F.col("weight") <= F.col("room")).select(*key, F.lit(1).cast("bigint").alias("times"), F.col("weight").alias("used")), "mix-more")
        if more.isEmpty():
            return chosen
        chosen = store(chosen.unionByName(more).groupBy(*key).agg(F.sum("times").alias("times"), F.sum("used").alias("used")), "mix-chosen")


def split_tree(quotas: np.ndarray, n_shards: int, lo: int, hi: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards ``lo`` to ``hi``: the first block and the number of blocks of each source."""
    def walk(first: int, last: int, offset: np.ndarray, count: np.ndarray):
        if last <= lo or first >= hi:
            return
        if last - first == 1:
            yield first, offset, count
            return
        mid = (first + last) // 2
        total = int(count.sum())
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(count, total * (mid - first) // (last - first), method="marginals") if total else count
        yield from walk(first, mid, offset, left)
        yield from walk(mid, last, offset + left, count - left)
    yield from walk(0, n_shards, np.zeros_like(quotas), quotas)


def plan(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS,
         max_repeats: int = MAX_REPEATS, shard_words: int = SHARD_WORDS, seed: int = 0) -> Mix:
    """Decide how often and where each document is taken."""
    spark = df.sparkSession
    rows = store(sized(df, text, id_col, source), "mix-rows")
    sources = source_table(rows, weights, max_repeats)
    sources["blocks"] = np.maximum(-(-sources["n"] // BLOCK_ROWS), 1)
    total = sources["source_size"].clip(lower=1)
    sources["full"] = np.minimum(np.floor(sources["target"] / total), max_repeats).astype("int64")
    sources["rest"] = np.maximum(sources["target"] - sources["full"] * sources["source_size"], 0.0)
    schema = "sid bigint, src string, n bigint, source_size bigint, target double, blocks bigint, full bigint, rest double"
    named = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in sources.astype(object).itertuples(index=False)], schema)
    small = F.broadcast(named)  # bounded by MAX_SOURCES
    keyed = rows.groupBy("id", "k64", "src", "size").agg(F.count(F.lit(1)).alias("m")).join(small, rows["src"].eqNullSafe(named["src"])).drop(named["src"])
    units = store(keyed.withColumn("u", _draw(seed, "id", "k64", "sid")).withColumn("block", F.floor(F.col("u") * F.col("blocks") / _SPAN).cast("bigint"))
                  .withColumn("weight", F.col("size") * F.col("m")).select("id", "k64", "src", "sid", "size", "weight", "u", "block", "source_size", "target"), "mix-units")
    blocks, chosen = last_pass(units, named, max_repeats, seed)

    # one row per block to take, numbered inside its source
    times, part = F.col("full") + F.col("whole"), F.col("part").cast("bigint")
    takes = blocks.filter(times + part > 0).select("sid", "block", "part", times.alias("n"), F.explode(F.sequence(F.lit(1).cast("bigint"), times + part)).alias("round"))
    takes = takes.select("sid", "block", "round", (F.col("round") > F.col("n")).alias("partial"))
    takes = takes.withColumn("place", _draw(seed + 2, "sid", "block", "round"))
    takes = store(ordinal(takes, ["sid"], ["place", "block", "round"], "rank", F.shiftright("place", 15)).drop("place"), "mix-takes")
    quotas = np.zeros(len(sources), np.int64)
    for r in takes.groupBy("sid").count().collect():
        quotas[r["sid"]] = r["count"]
    n_shards = max(1, min(int(quotas.sum()), -(-int(sources["source_size"].sum()) // shard_words)))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group in pdf["id"]:
                for shard, offset, count in split_tree(quotas, n_shards, group * 64, min(n_shards, group * 64 + 64), seed):
                    sid = np.flatnonzero(count)
                    yield pd.DataFrame({"sid": sid, "shard": np.full(len(sid), shard), "offset": offset[sid], "count": count[sid]})

    leaves = spark.range(-(-n_shards // 64)).mapInPandas(expand, "sid bigint, shard bigint, offset bigint, count bigint")
    dealt = leaves.select("sid", "shard", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("count") - 1)).alias("rank"))
    placed = takes.join(dealt, ["sid", "rank"]).groupBy("sid", "block").agg(F.collect_list(F.struct("round", "shard", "partial")).alias("takes"))
    same = (F.col("a.sid") == F.col("c.sid")) & F.col("a.id").eqNullSafe(F.col("c.id")) & F.col("a.k64").eqNullSafe(F.col("c.k64"))
    found = units.join(placed, ["sid", "block"], "left").alias("a").join(chosen.alias("c"), same, "left").select("a.*", F.coalesce("times", F.lit(0)).alias("times"))

    def repeated(t: Column) -> Column:
        more = F.transform(F.sequence(F.lit(1), F.greatest("times", F.lit(1))), lambda i: F.struct((t["round"] + i - 1).alias("round"), t["shard"].alias("shard")))
        return F.slice(more, F.lit(1), F.when(t["partial"], F.col("times")).otherwise(F.lit(1)).cast("int"))
    takes = F.coalesce("takes", F.array().cast("array<struct<round: bigint, shard: bigint, partial: boolean>>"))
    return Mix(found.select("id", "k64", "src", "size", "source_size", "target", F.flatten(F.transform(F.array_sort(takes), repeated)).alias("takes")), n_shards)


def attach_plan(df: DataFrame, mix: Mix, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of ``df`` (as struct ``row``) with its size, source size, target and takes."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("r_id"),
                     F.xxhash64(F.col(f"`{text}`")).alias("r_k64"), F.col(f"`{source}`").cast("string").alias("r_src"))
    same = F.col("r_id").eqNullSafe(F.col("id")) & (F.col("r_k64") == F.col("k64")) & F.col("r_src").eqNullSafe(F.col("src"))
    return rows.join(mix.units, same).select("row", "size", "source_size", "target", "takes")


def draw_mix(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mix itself: rows of ``df`` as often as they are taken, with ``shard``, rows of a shard
    together and in seeded random order."""
    mix = plan(df, text, id_col, source, seed=seed, **options)
    drawn = attach_plan(df, mix, text, id_col, source).select("row", F.explode("takes").alias("take"))
    place = _draw(seed + 3, F.col(f"row.`{id_col}`"), F.col(f"row.`{text}`"), "take.round")
    out = drawn.select("row", F.col("take.shard").alias("shard"), place.alias("place"))
    # shards are dealt to tasks in turn: few shards hashed to tasks would leave some with several, others with none
    tasks = min(mix.n_shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "place")
    return out.select("row.*", "shard")
