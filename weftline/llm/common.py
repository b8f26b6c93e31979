"""What the operators share: safe input columns, shared intermediate tables, prefix sums over split groups."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space; upper-case letters here are A-Z only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    steady_reads(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady_reads(spark: SparkSession) -> None:
    """Reads Parquet pages as they are needed. Vectored reads would keep whole column chunks, tens of
    MB for texts, in buffers outside the heap for each reading thread."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that Python workers can import it
    wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    to = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "weftline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(to))
    sc._weftline_shipped = True


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is named by spark.checkpoint.dir; only where
    that is unset in local mode (tests) a temporary folder takes its place."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back. That cuts the lineage,
    survives the loss of executors and is smaller than a checkpoint of rows."""
    spark = df.sparkSession
    steady_reads(spark)
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes the table behind a frame from materialize() that nothing reads any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(rows: int, per_bucket: int = 20_000, least: int = 64, most: int = 65_536) -> int:
    """How many buckets keep about per_bucket rows in each."""
    return int(min(most, max(least, rows // per_bucket)))


def running_offsets(df: DataFrame, group: list[str], order: list[str], size: str, out: str, buckets: int) -> DataFrame:
    """Adds out: the sum of size over the earlier rows of the same group.

    A group may hold a third of all rows, so no window spans a whole group. Rows fall into buckets by
    a hash of the order columns; one window runs within (group, bucket), another over the few totals
    of each group's buckets. The order is (bucket, order columns): arbitrary, yet the same in each run.
    """
    b = "__bucket"
    tagged = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = tagged.groupBy(*group, b).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, b, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    # The bucket is a key of its own, so that the join and the window below share one exchange.
    within = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = tagged.withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    on = [inner[g].eqNullSafe(starts[g]) for g in group] + [inner[b] == starts[b]]
    joined = inner.join(starts, on, "left")
    keep = [inner[c] for c in df.columns]
    return joined.select(*keep, (inner["__within"] + F.coalesce(starts["__start"], F.lit(0))).alias(out))
