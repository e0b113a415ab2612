"""Session factory, shared-folder tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows (under about 100 bytes) may be broadcast.
BROADCAST_ROWS = 200_000


def session(app: str = "tidewater", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app).master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names. Where none is named, a local one, if the session has no executors elsewhere; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        else:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="tidewater-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
            named = f"file://{named}"
            spark.sparkContext.setCheckpointDir(named)
    return named


_WRITTEN: list[str] = []


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any store, None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    with_stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
    finally:
        with_stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it into it, so a reader sees the old one or the new one."""
    p, fs = _path(spark, path)
    new, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"{path} couldn't be written")


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            clear_written(spark)
        except Exception:  # the session may have ended by then
            pass


def clear_written(spark: SparkSession) -> None:
    """Deletes the tables that written() made so far, as is done when the program ends. Results that still read them can't be used any more."""
    while _WRITTEN:
        p, fs = _path(spark, _WRITTEN.pop())
        fs.delete(p, True)


def written(df: DataFrame, label: str = "t", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors. by: a column with a few values, each in a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)
    if not _WRITTEN:
        atexit.register(_clear_at_exit)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else unchanged (then a shuffle join)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df
