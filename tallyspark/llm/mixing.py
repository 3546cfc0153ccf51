"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

1. Sizes are summed per source; the targets fill up by weight, none above its cap.
2. The mix is cut into blocks of equal tokens and the blocks into shards. Every shard boundary is
   a house size: the blocks go to the sources with the highest quotients target / (2 s + 1), and
   a shard's quota is the difference of two house sizes. Only quotients near the ideal share are
   listed, so the work follows sources times shards, not blocks.
3. A source's documents stand in an order seeded by a hash; its stream of tokens is cut into the
   same blocks. Of m blocks, q are taken evenly from a seeded start: block b is taken
   floor(((b + 1) q + r) / m) - floor((b q + r) / m) times. So what a document gives follows from
   its place in the stream alone, without listing blocks. A place is the sum over the hash
   buckets before it plus the sum within its bucket, so that a source that holds a third of all
   rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source -> with place, weight and target.

    Sources stand by code point, null last; the weights repeat along them. Targets are level times
    weight, where level * weight is cut at ``cap`` times the size. The sources that are cut have the
    smallest size per weight, so one pass in that order finds the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    placed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap
    level = left / F.sum("weight").over(after)
    levels = placed.withColumn("level", level)
    # the first source that is not cut at its own level fixes the level for all after it
    fits = F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))
    levels = levels.withColumn("first", F.min(fits).over(everyone))
    target = F.least(F.coalesce(F.col("first.level") * F.col("weight"), cap * F.col("source_size")), cap * F.col("source_size"))
    return levels.select("source", "source_size", "place", "weight", target.cast("double").alias("target"))


def quotas(goals: DataFrame, block: int, shard_blocks: int) -> DataFrame:
    """Sainte-Laguë: ``goals(place, target)`` -> (shard, place, blocks), integer blocks per shard and source."""
    total, n = goals.agg(F.sum("target"), F.count(F.lit(1))).first()
    if not total:
        return goals.select(F.lit(0).cast("long").alias("shard"), "place", F.lit(0).cast("long").alias("blocks"))
    seats = round(total / block)
    houses = -(-seats // shard_blocks)
    shards = goals.sparkSession.range(houses).select(F.col("id").alias("shard"), F.least((F.col("id") + 1) * shard_blocks, F.lit(seats)).alias("house"))
    share = F.col("target") / F.lit(float(total))
    ideal = F.floor(share * F.col("house") + 0.5)
    room = F.ceil(share * (2 * n)).cast("long") + 2  # a quota strays no further from the rounded share
    near = goals.filter("target > 0").crossJoin(F.broadcast(shards)).select("shard", "house", "place", "target", F.greatest(F.lit(0), ideal - room).cast("long").alias("least"), (ideal + room).cast("long").alias("most"))
    given = near.groupBy("shard").agg(F.sum("least").alias("given"))
    open_ = near.join(given, "shard").withColumn("s", F.explode(F.sequence("least", "most")))
    best = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("s") + 1)), "place")
    won = open_.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= F.col("house") - F.col("given")).groupBy("shard", "place").agg(F.count(F.lit(1)).alias("won"))
    whole = near.join(won, ["shard", "place"], "left").select("shard", "place", (F.col("least") + F.coalesce("won", F.lit(0))).alias("whole"))
    so_far = F.lag("whole", 1, 0).over(Window.partitionBy("place").orderBy("shard"))
    return whole.select("shard", "place", (F.col("whole") - so_far).alias("blocks"))


def _mixed(rows: DataFrame, seed: int, block: int | None, shard_blocks: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows(doc_id, source, size, tie)`` -> the rows with taken, and the quotas per shard."""
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    goals = checkpointed(targets(sizes).join(sizes.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    if block is None:  # a source's taken words stray by about a block, so 1 % at most of the smallest target
        least = goals.filter("target > 0").agg(F.min("target")).first()[0] or 1.0
        block = int(max(1, min(1024, least // 100)))
    shares = checkpointed(quotas(goals, block, shard_blocks))
    won = shares.groupBy("place").agg(F.sum("blocks").alias("q"))
    ceil_div = F.expr(f"(source_size + {block - 1}) div {block}")
    plan = goals.join(won, "place", "left").withColumn("m", ceil_div).withColumn("q", F.least(F.coalesce("q", F.lit(0)), 2 * F.col("m")))
    plan = plan.withColumn("r", F.when(F.col("m") > 0, F.pmod(F.xxhash64(F.lit(seed), "place"), F.col("m"))).otherwise(F.lit(0)))
    plan = checkpointed(plan.withColumn("buckets", F.expr(f"greatest(1, n_docs div {bucket_rows})")))
    small = plan.count() <= 10_000
    side = F.broadcast(plan) if small else plan
    ranked = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tie", "size")).withColumnRenamed("source", "src")
    ranked = ranked.join(side, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    # buckets split the hashes evenly and in order
    ranked = ranked.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 12).cast("double") / float(1 << 52)) * F.col("buckets")).cast("long"))
    ranked = checkpointed(ranked)
    sums = ranked.groupBy("place", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("place", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("place", "bucket").orderBy(F.shiftrightunsigned("h", 12), "h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranked.withColumn("inside", F.sum("size").over(within)).join(starts, ["place", "bucket"])
    ends = ends.withColumn("end", F.col("before") + F.col("inside")).withColumn("start", F.col("end") - F.col("size"))

    def taken_before(x: str) -> str:
        b = f"({x} div {block})"
        exact = f"((cast({b} as decimal(19,0)) * cast(q as decimal(18,0)) + r) div m)"
        after = exact.replace(b, f"({b} + 1)")
        return f"({block} * {exact} + ({x} % {block}) * ({after} - {exact}))"

    taken = F.expr(f"case when m = 0 or size = 0 then 0L else {taken_before('end')} - {taken_before('start')} end")
    return ends.withColumn("taken", taken.cast("long")), shares


def mix(docs: DataFrame, seed: int = 42, block: int | None = None, shard_blocks: int = 1 << 20, bucket_rows: int = 2000) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: doc_id, size, source_size, target, taken.

    A null text has size 0 and gives nothing; a null source is a source of its own, the last.
    Rows without doc_id and repeated rows take part like any other; rows that agree in all of
    doc_id, source and text are alike, so which of them gives more doesn't matter. Other columns
    are not read. If all sizes are 0, targets and taken are 0. Reruns agree: the order depends
    on values only.
    """
    rows = checkpointed(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    return _mixed(rows, seed, block, shard_blocks, bucket_rows)[0].select("doc_id", "size", "source_size", "target", "taken")


def shard_quotas(docs: DataFrame, block: int = 1024, shard_blocks: int = 1 << 20, seed: int = 42) -> DataFrame:
    """(source, shard, blocks): how many blocks each shard takes from each source."""
    sizes = docs.select("source", size_of(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = checkpointed(targets(sizes))
    return quotas(goals, block, shard_blocks).join(goals.select("place", "source"), "place").select("source", "shard", "blocks")
