"""Intermediate tables: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a table whose size has been checked is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a join of repeated keys that one task gives, rows of a key in a tile and in a list.
PAIRS = 20_000_000
TILE = 256
LISTED = 4096


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_pathloom_own", None)
    if own is None:
        own = spark.sparkContext._pathloom_own = tempfile.mkdtemp(prefix="pathloom-")
    return f"file://{own}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: lineage is cut, lost executors cost a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote."""
    path = getattr(df, "_pathloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the number (from 0) of every row in the given order, ties in any.  Rows are
    sorted in range partitions, whose sizes are added up, so that no task sees all rows."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ordered = materialise(ordered, "numbered")
    sizes = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__i").alias("__first"))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return ordered.join(F.broadcast(starts), "__p").withColumn(name, F.col("__i") - F.col("__first") + F.col("__before")).drop("__p", "__i", "__first", "__before")


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for a broadcast if it has few enough rows, else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def multiplied(left: DataFrame, right: DataFrame, on: list[str], tiled: bool = False, more: float = 1.0, spread: bool = True) -> DataFrame:
    """Inner join of sides whose keys repeat on both, so that few rows in give many out: the
    work is dealt by the rows that come out.  A small side is broadcast in lists, the other one
    spread over tasks; else (or if ``tiled``) the right rows of a key are dealt to tiles of about
    ``TILE`` and the left ones go to each, so that no key is one task's, and rows that repeat
    follow each other closely (they compress when written).  ``more``: rows that each row
    gives in a join after this one; ``spread``: whether the left side is not spread yet."""
    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    a, b = (df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "__a"), (right, "__b")))
    n = a.join(b, on, "full").agg(F.sum(F.col("__a").cast("double") * F.col("__b")), F.sum("__a"), F.sum("__b")).first()
    total, n_left, n_right = ((n[0] or 0) * more, n[1] or 0, n[2] or 0)
    if total <= PAIRS or set(left.columns) == set(on) or set(right.columns) == set(on):
        return left.join(right, on).select(*columns)
    tasks = max(2 * left.sparkSession.sparkContext.defaultParallelism, min(20_000, -(-int(total) // PAIRS)))
    if not tiled:
        if not spread:  # the left side stays where it is
            n_left = max(n_left, n_right)
        if min(n_left, n_right) <= BROADCAST_ROWS:
            small, large = (left, right) if n_left < n_right else (right, left)
            rest = [c for c in small.columns if c not in on]
            # arrays of the rows of a key, so that one look-up gives up to LISTED of them
            lists = small.withColumn("__part", F.pmod(F.xxhash64(*rest), F.lit(max(1, min(n_left, n_right) // LISTED)))).groupBy(*on, "__part").agg(F.collect_list(F.struct(*rest)).alias("__rows")).drop("__part")
            given = F.inline("__rows")
            if len(rest) == 1:  # no struct around a single value
                lists = lists.withColumn("__rows", F.transform("__rows", lambda x: x[rest[0]]))
                given = F.explode("__rows").alias(rest[0])
            large = large.repartition(tasks) if spread else large
            return large.join(F.broadcast(lists), on).select(*on, *(c for c in large.columns if c not in on), given).select(*columns)
    sizes = b.select(*on, F.ceil(F.col("__b") / TILE).alias("__tiles"))
    rest = [F.col(c) for c in right.columns]
    dealt = right.join(sizes, on).withColumn("__tile", F.pmod(F.xxhash64(*rest), F.col("__tiles"))).drop("__tiles")
    copied = left.join(sizes, on).withColumn("__tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tiles") - 1))).drop("__tiles")
    return copied.repartition(tasks, *on, "__tile").hint("merge").join(dealt, [*on, "__tile"]).select(*columns)
