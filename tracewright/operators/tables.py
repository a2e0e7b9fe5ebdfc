"""The shared folder of the session, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
SMALL_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in this one process (tests, a
    laptop) a temporary folder is made and set; on a cluster a machine's own
    folder would lose rows, so that raises instead.
    """
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not in_one_process(spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def in_one_process(master: str) -> bool:
    """Whether a master runs driver and executors in one process.

    >>> [in_one_process(m) for m in ("local", "local[8]", "local-cluster[3,2,1024]", "yarn")]
    [True, True, False, False]
    """
    return master == "local" or master.startswith("local[")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:
        pass  # the session is gone; the cluster's own cleaning applies


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: the table survives the loss of any executor, and later
    stages never recompute what led to it. The table is removed by ``release``
    or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_table = path
    atexit.register(_remove, spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` returned and nothing reads any more."""
    for t in tables:
        path = getattr(t, "_tracewright_table", None)
        if path:
            _remove(t.sparkSession, path)


def in_blocks(df: DataFrame, key: str, most: int = SMALL_ROWS) -> list[DataFrame]:
    """``df`` in parts of about ``most`` rows or less, by a hash of ``key``; one part if it is that small.

    Parts are what may be broadcast one at a time; all rows are in one of them.
    """
    n = df.count()
    if n <= most:
        return [df]
    parts = -(-2 * n // most)  # half full on average, so that hardly any exceeds it
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]
