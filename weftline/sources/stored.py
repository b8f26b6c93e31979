"""Tables in the folder that driver and executors share: results that are read twice, and indexes that outlive a query."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset under a local master, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder: its lineage is cut, and lost executors do not matter."""
    path = f"{shared_dir(df.sparkSession)}/weftline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def state_of(df: DataFrame) -> str:
    """A digest of the files behind df, their lengths and times, by which a stored index knows what it was built from."""
    spark, parts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        p, fs = _filesystem(spark, name)
        s = fs.getFileStatus(p)
        parts.append(f"{name}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def built_once(source: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The path of what build(path) writes for the source's files as they are now. It is built in a folder of its own that is
    renamed once complete, so that readers never see a part of it, and who comes second keeps the first."""
    spark = source.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{state_of(source)}"
    p, fs = _filesystem(spark, path)
    if not fs.exists(p):
        half = f"{path}.{uuid.uuid4().hex}"
        build(half)
        h = spark._jvm.org.apache.hadoop.fs.Path(half)
        if fs.exists(p) or not fs.rename(h, p):
            fs.delete(h, True)
    return path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that Python workers can import it."""
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
