"""Session helpers: tables written to the shared folder, Arrow batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bounds of an Arrow batch that goes to Python: rows, and bytes (a batch ends with the row that passes them).
BATCH_ROWS, BATCH_BYTES = "1000", str(4 << 20)
#: Rows that Spark's Parquet reader decodes at a time: long texts would make great arrays of its 4,096.
READ_ROWS = "512"
#: Characters of texts that an operator works on at a time; a longer text is worked on alone.
SLICE_CHARS = 1 << 20


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, however the driver came to import it."""
    sc = spark.sparkContext
    if getattr(sc, "_nearnames_shipped", False):
        return
    top = Path(__file__).resolve().parent
    # The driver serves this file to executors for as long as the session lives.
    packed = Path(tempfile.mkdtemp(prefix="nearnames-")) / "nearnames.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(packed))
    sc._nearnames_shipped = True


def tune(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches in rows and bytes, and the batches of the Parquet reader.

    Lazy results read these settings when they run, so they stay set; a setting that the
    session's owner has changed from Spark's default is left alone.
    """
    ship(spark)
    bounds = (("execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES), ("parquet.columnarReaderBatchSize", "4096", READ_ROWS))
    for name, default, bound in bounds:
        key = f"spark.sql.{name}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def slices(texts: list[str], chars: int = SLICE_CHARS):
    """``texts`` in runs of at most ``chars`` characters, or of one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > chars:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield texts[begin:]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name, ``name`` if possible, that none of ``frames`` has (names are told apart without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


_slot: dict = {}


def _trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_state(key, make):
    """What ``make`` gave for ``key``, kept in this Python worker until another key is asked for.

    Workers outlive tasks and stages. With one place for all operators, a worker holds
    the memo or model of the operator that it is running, not of all that it has run.
    """
    if key not in _slot:
        if _slot:
            _slot.clear()
            gc.collect()
            _trim()
        _slot[key] = make()
    return _slot[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a single machine a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nearnames-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, mostly finished plans: left alone, the JVM grows its heap to the limit before it collects any."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and fixes whatever was
    not deterministic (partition ids, random columns) for all later readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._nearnames_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_nearnames_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder.

    For the end of an application: lazy results that read such tables end with them.
    """
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
