"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting by which the shuffle files of a finished query are removed.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared folder (spark.checkpoint.dir).

    Only where that setting is unset, as in tests, is a folder of our own taken.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what is read more than once, by few columns or compressed.

    Nothing behind the table is read again, so Spark may remove the shuffles that made it.
    """
    spark = df.sparkSession
    checkpointed(spark.range(1))  # sets the folder where it is unset
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def identity(text: str, *names: str) -> dict[str, Column]:
    """Independent 64-bit hashes of a column, by name: two of them tell all texts of a corpus apart.

    The number comes first, so it seeds the hash; as a last argument it would only be added to the first hash.
    """
    return {name: F.xxhash64(F.lit(i), F.col(text)) for i, name in enumerate(names)}


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` without self-loops -> ``(node, component)`` for every node that has an edge.

    Hooking and pointer jumping over DataFrames: a node takes the smallest parent among its
    neighbours, passes it to its own parent, then every node jumps to its parent's parent. The
    number of rounds is about the logarithm of the diameter. ``component`` is the smallest node.
    Only one flag a round comes to the driver. A large component makes a hot parent: the
    minimum over it is combined map-side, the jump is a plain join that adaptive execution splits.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        seen = checkpointed(labels.join(near, "node"))
        if not seen.filter("near <> component").limit(1).count():
            return labels
        hooked = seen.select("node", F.least("component", "near").alias("component")).union(seen.select(F.col("component").alias("node"), F.least("component", "near").alias("component")))
        hooked = checkpointed(hooked.groupBy("node").agg(F.min("component").alias("component")))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = checkpointed(hooked.join(up, "component").select("node", F.col("root").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
