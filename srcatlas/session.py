"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling.

On a cluster the caller owns the session; the library only reads settings from it.
"""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins at runtime (broadcasts a
# side only after measuring it), coalesces small shuffle partitions and splits
# skewed ones; dynamic partition overwrite gives S4 its "replace this repo only"
# semantics.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "srcatlas", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark (never used by library code)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.driver.memory", os.environ.get("SRCATLAS_DRIVER_MEM", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must point at shared storage and is only read here.
    A local-mode session without it (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
        path = "file://" + tempfile.mkdtemp(prefix="srcatlas-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


_SHIPPED: set = set()
_TABLES: dict[str, list[str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``srcatlas`` importable in Python workers (for pandas-backed operators).

    The package is zipped in memory once per SparkContext, written through the Hadoop
    file system to the shared folder of ``spark.checkpoint.dir`` and added with
    ``addPyFile``, which distributes it to every executor.
    """
    import io
    import uuid
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for d, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    zf.write(full, os.path.relpath(full, root))
    target = sc._jvm.org.apache.hadoop.fs.Path(
        f"{ensure_checkpoint_dir(spark).rstrip('/')}/srcatlas-py/srcatlas-{uuid.uuid4().hex}.zip")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(fs.makeQualified(target).toString())
    _SHIPPED.add(key)


def released(run):
    """The Arrow or pandas function ``run`` whose task gives its memory back when it ends.

    Python workers outlive their tasks; what the allocators keep would add up over the stages of a job.
    """
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def give_back() -> None:
    """Return to the system what this Python process has freed but its allocators keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows that an Arrow function turns into Python values at a time; a batch of Spark's may have 10,000.
SLICE_ROWS = 256


def sliced(batches, rows: int = SLICE_ROWS):
    """The same rows in slices of at most ``rows``, which share the batch's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` that ``drop_tables`` deletes."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/srcatlas-tables/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df, name: str = "table"):
    """Cut lineage by writing ``df`` as Parquet under ``spark.checkpoint.dir`` and reading it back.

    One computation (an eager RDD checkpoint runs the plan twice), columnar and
    compressed, and on shared storage, so it survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete every table written under a ``scratch_path`` in this application; returns how many.

    To be called once the results that read them have been written.
    """
    sc = spark.sparkContext
    paths = _TABLES.pop(sc.applicationId, [])
    for p in paths:
        target = sc._jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
