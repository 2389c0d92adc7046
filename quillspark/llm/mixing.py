"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes are summed by source. Weighted shares of the total become targets, each at most ``cap`` times its
   source's size; the excess is reshared by weight until none is above (``water_fill``).
2. A source's documents fall into permuted blocks by a seeded hash. A target asks for so many whole passes
   over the source and a remainder; the remainder takes blocks in permuted order, documents in permuted order
   inside the one block at its edge. Documents that still fit what is open are then walked in a permuted order
   again, by block sums and one by one in the block at the edge, until no document left would fit.
   If one more document then brings a source nearer to its target than none, the smallest left is taken too.
3. The taken blocks of all sources are dealt to output shards by a splitting tree: every node halves its
   shards and draws, without replacement, how many blocks of each source go left. So every shard gets a block
   quota that is an exact multivariate-hypergeometric draw, and quotas add up to what each source owes. Sources
   are drawn in two steps of one law: first by groups of sources, then, in a task for each group, by source.
4. Each source's permuted block instances fill the quotas in order, so the draws are disjoint; inside a
   shard, rows are put in order by a seeded hash (``shard_rows``).

Everything is a function of ids, sizes and the seed, not of partitioning: reruns agree. Sources stay in tables, however
many they are: only sums over all of them and one row for each group of sources come to the driver. Windows run over at
most ``blocks`` rows of a source, or over one block's documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.lineage import by_merging, cut

WORD = r"[^\x20\x09-\x0D]+"


#: Groups of sources in the first step of the splitting tree.
GROUPS = 256


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with place (long): the position by ``key``, from 0. One count for each range comes to the driver."""
    ranged = cut(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())
    starts = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))
    return ranged.join(before, "range").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1 + F.col("before")).drop("range", "before")


def water_fill(sources: DataFrame, cap: float) -> DataFrame:
    """``sources`` (size, weight) with target: weighted shares of all sizes, none above cap * size; excess is reshared.

    Each round finds the sources that their share at the present level would overfill; a source once found stays so,
    since what the others share only grows. Rounds are sums over all sources, and end when none is found anew.
    """
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    full, found = F.lit(False), -1
    limit = F.col("source_size") * F.lit(float(cap))
    while True:
        n, held, weight = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if weight is None:
            return sources.withColumn("target", limit)
        share = F.lit(total - cap * (held or 0)) * F.col("weight") / F.lit(float(weight))
        if n == found:
            return sources.withColumn("target", F.least(share, limit))
        full, found = share > limit, n


def splitting_tree(blocks: Sequence[int], shards: int, seed: int, quotas: Sequence[int] | None = None) -> np.ndarray:
    """quota[shard, source]: how many of each source's blocks a shard gets; columns add up to ``blocks``.

    ``quotas`` says how many blocks each shard gets in all; without it they are as even as can be.
    """
    quota = np.zeros((shards, len(blocks)), dtype=np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            quota[lo] = counts
            return
        mid = (lo + hi) // 2
        draw = int(counts.sum()) * (mid - lo) // (hi - lo) if quotas is None else int(sum(quotas[lo:mid]))
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, draw, method="marginals") if draw else np.zeros_like(counts)
        split(left, lo, mid)
        split(counts - left, mid, hi)

    if len(blocks):
        split(np.asarray(blocks, dtype=np.int64), 0, shards)
    return quota


def _shard_quotas(owed: DataFrame, shards: int, seed: int) -> DataFrame:
    """src and ends (array<long>): up to which of its block instances each shard gets, of sources that owe ``owed`` blocks."""
    grouped = owed.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + 7), "src"), F.lit(GROUPS)).cast("int"))
    sums = sorted((r["group"], r["owed"]) for r in grouped.groupBy("group").agg(F.sum("owed").alias("owed")).collect())
    per_group = splitting_tree([n for _, n in sums], shards, seed)
    quotas = owed.sparkSession.createDataFrame([(g, [int(n) for n in per_group[:, i]]) for i, (g, _) in enumerate(sums)], "group int, quotas array<long>")

    def split(group: pa.Table) -> pa.Table:
        group = group.sort_by("src")
        drawn = splitting_tree(group["owed"].to_pylist(), shards, seed + 1000 + group["group"][0].as_py(), group["quotas"][0].as_py()).cumsum(axis=0)
        return pa.table({"src": group["src"], "ends": pa.array(drawn.T.tolist(), pa.list_(pa.int64()))})

    return grouped.join(F.broadcast(quotas), "group").groupBy("group").applyInArrow(split, "src string, ends array<long>")


def _walk(seed: int) -> Callable[[pa.Table], pa.Table]:
    """Takes, of one block's documents in a seeded order, each that still fits what is left."""

    def walk(block: pa.Table) -> pa.Table:
        ids, sizes = block.column("id").to_pylist(), block.column("size").to_pylist()
        left, extra = block.column("left")[0].as_py(), [False] * len(ids)
        for _, _, size, i in sorted((xxhash.xxh3_64_intdigest(str(d).encode("utf-8", "surrogatepass"), seed=seed), str(d), n, i) for i, (d, n) in enumerate(zip(ids, sizes, strict=True))):
            if size <= left:
                left, extra[i] = left - size, True
        return block.drop_columns(["left", "extra"]).append_column("extra", pa.array(extra, pa.bool_()))

    return walk


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    blocks: int = 1024,
    shards: int = 16,
    seed: int = 17,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken (words), copies.

    ``copies`` is an array of struct<shard, pass, sort_key>, one for each time the document is taken. Sources in
    code-point order (null last, a source of its own) get ``weights`` in turn. Null texts have size 0, and take
    part with size 0. Repeated rows count as often as they occur; each is taken or left by itself, so rows alike may
    have different ``taken``. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int")
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), block.alias("block")).withColumn("src", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))))
    by_block = cut(sized.groupBy("src", "block").agg(F.sum("size").alias("block_size")))

    # "=name" comes before "null" in byte order, so sources are in code-point order and the null source is last.
    sources = _numbered(by_block.groupBy("src").agg(F.sum("block_size").alias("source_size")), "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    plan = water_fill(cut(sources.select("src", "source_size", weight.alias("weight"))), cap)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = cut(plan.select("src", "source_size", "target", "passes", "rest"))

    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by_block.join(plan, "src")
    ranked = ranked.withColumn("upto", F.sum("block_size").over(order))
    before = F.col("upto") - F.col("block_size")
    ranked = ranked.withColumn("edge", F.when((before < F.col("rest")) & (F.col("upto") > F.col("rest")), F.col("rest") - before))
    ranked = ranked.withColumn("more", (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0) | F.col("edge").isNotNull())
    ranked = cut(ranked.select("src", "block", "source_size", "target", "passes", "edge", "more"))

    owed = cut(ranked.groupBy("src").agg(F.sum(F.col("passes") + F.col("more").cast("int")).alias("owed")))
    quotas = _shard_quotas(owed, shards, seed)

    rounds = ranked.withColumn("pass", F.explode(F.when(F.col("passes") + F.col("more").cast("int") > 0, F.sequence(F.lit(0), F.col("passes") + F.col("more").cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
    turn = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "block", "pass"), "block", "pass")
    dealt = rounds.withColumn("turn", F.row_number().over(turn)).join(quotas, "src")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("turn"))))
    shards_of = dealt.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))

    rows = sized.join(by_merging(ranked.join(shards_of, ["src", "block"], "left")), ["src", "block"])
    inside = Window.partitionBy("src", "block").orderBy(F.xxhash64(F.lit(seed + 3), "id"), "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = rows.filter(F.col("edge").isNotNull()).withColumn("upto", F.sum("size").over(inside))
    at_edge = at_edge.withColumn("again", F.col("upto") <= F.col("edge")).drop("upto")
    rows = cut(rows.filter(F.col("edge").isNull()).withColumn("again", F.col("more")).unionByName(at_edge))

    # What the edge leaves open is filled by further walks over the documents that still fit, until none does.
    # An edge block's documents are tried one by one, so what stays open is below the least that it has left.
    slot = F.struct(F.xxhash64(F.lit(seed + 5), "block").alias("h"), "block")
    upto = F.sum("block_size").over(Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("extra", F.lit(False))
    # What holds for a source reaches its documents by way of its blocks, so a source with a third of all rows is spread.
    by_blocks = lambda of_source: by_block.select("src", "block").join(of_source, "src")
    untaken = ~F.col("again") & ~F.col("extra") & (F.col("size") > 0)

    def walk(rows: DataFrame, stops: DataFrame) -> DataFrame:
        """Takes what fits in the blocks before each source's ``stop``, and there one by one while it fits ``left``."""
        fits = F.coalesce(untaken & (F.col("size") <= F.col("open")), F.lit(False))
        at = F.when(~fits, 0).when(F.col("stop").isNull() | (slot < F.col("stop")), 1).when(slot == F.col("stop"), 2).otherwise(0)
        walked = cut(rows.join(by_merging(by_blocks(stops)), ["src", "block"], "left").withColumn("at", at))
        plain = walked.filter("at < 2").withColumn("extra", F.col("extra") | (F.col("at") == 1)).select(rows.columns)
        tried = walked.filter("at = 2").select(*rows.columns, "left").groupBy("src", "block").applyInArrow(_walk(seed), rows.schema)
        return cut(plain.unionByName(tried))

    while True:
        used = rows.groupBy("src").agg(F.sum(F.when(F.col("again") | F.col("extra"), F.col("size")).otherwise(0)).alias("n"), F.min(F.when(untaken, F.struct("size", slot.alias("slot")))).alias("least"))
        open_ = cut(used.filter("least IS NOT NULL").join(plan.select("src", "rest"), "src").select("src", (F.col("rest") - F.col("n")).alias("open"), "least"))
        short = open_.filter(F.col("least.size") <= F.col("open")).select("src", "open")
        if short.isEmpty():
            break
        sums = rows.join(by_merging(by_blocks(short)), ["src", "block"]).filter(untaken & (F.col("size") <= F.col("open"))).groupBy("src", "open", "block").agg(F.sum("size").alias("block_size")).withColumn("slot", slot).withColumn("upto", upto)
        edges = sums.filter(F.col("upto") > F.col("open")).groupBy("src").agg(F.min(F.struct("slot", (F.col("open") - F.col("upto") + F.col("block_size")).alias("left"))).alias("e"))
        rows = walk(rows, short.join(edges.select("src", F.col("e.slot").alias("stop"), F.col("e.left").alias("left")), "src", "left"))
    nearer = open_.filter(F.col("least.size") < 2 * F.col("open")).select("src", F.col("least.size").cast("double").alias("open"), F.col("least.slot").alias("stop"), F.col("least.size").cast("double").alias("left"))
    if not nearer.isEmpty():
        last = rows.join(by_merging(by_blocks(nearer.select("src", "stop"))), ["src", "block"], "left").withColumn("only", F.coalesce(slot == F.col("stop"), F.lit(False))).drop("stop").select(*rows.columns, "only")
        rows = walk(last.filter("only").drop("only"), nearer).unionByName(last.filter("NOT only").drop("only"))
    # A document at the edge has its block's shard for the last pass; others that were walked to get one of their own.
    none = F.array().cast("array<struct<pass:int,shard:int>>")
    dealt = F.coalesce("dealt", none)
    alone = F.col("extra") & ~F.exists(dealt, lambda c: c["pass"] == F.col("passes"))
    single = F.array(F.struct(F.col("passes").alias("pass"), F.pmod(F.xxhash64(F.lit(seed + 6), "id"), F.lit(shards)).cast("int").alias("shard")))
    rows = rows.withColumn("dealt", F.concat(dealt, F.when(alone, single).otherwise(none)))
    times = F.col("passes") + (F.col("again") | F.col("extra")).cast("int")
    copies = F.transform(
        F.filter("dealt", lambda c: c["pass"] < times),
        lambda c: F.struct(c["shard"].alias("shard"), c["pass"].alias("pass"), F.xxhash64(F.lit(seed + 4), F.col("id"), c["pass"]).alias("sort_key")),
    )
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), copies.alias("copies"))


def shard_rows(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix as it is written out: id, shard and position inside the shard's own shuffled order, one row a copy.

    Positions are the seeded sort keys; sort within partitions of ``repartition('shard')`` to write shards.
    """
    return mixed.select(F.col(id_col), F.explode("copies").alias("c")).select(id_col, "c.shard", "c.pass", "c.sort_key")
