"""Connected components by alternating large-star and small-star rounds, each cut by a real write.

Every round is one aggregation (minimum a node, combined on the map side) and one join back, so a hub
with any number of neighbours is never gathered in one place: the join may be split by AQE."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset one in the warehouse, or on a single machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="loomfuse-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomfuse-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _cut(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(*written: DataFrame) -> None:
    """Delete what ``_cut`` wrote for tables that nothing reads any more."""
    for df in written:
        if path := getattr(df, "cut_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeats go with the small star


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``u``, ``label``: the smallest node of the component, for every node of ``edges`` (u, v: comparable, not null) but the smallest
    ones themselves. Loops and repeated edges do no harm; no edges give no rows."""
    now = _cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        large = _cut(_large_star(now))
        then = _cut(_small_star(large))
        drop_cut(now, large)  # the next round is written
        now = then
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select("u", F.col("v").alias("label"))
