"""What the operators of this subpackage share: reading tables, cutting lineage, digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch. Texts run to megabytes, so batches stay small.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once, unless the session has a tighter bound already."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(name, None)
        digits = (held or "").lower().rstrip("b")
        if not digits.lstrip("-").isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where it is unset, as in tests, a local session gets a folder of its own; a cluster doesn't."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system named, as Spark resolves it, so that Python workers open the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stratified(rows: DataFrame, strata: list[str], key: str, at_most: int, seed: int) -> tuple[DataFrame, dict[tuple, tuple[int, int]]]:
    """A sample of about at_most rows in all, drawn by a hash of the key: of each stratum (what the columns strata hold; few values) an equal part, or all of a small one.

    Returns it with, for each stratum, its number of rows and its threshold: 2**30 * the share that was drawn.
    """
    counts = {tuple(r[c] for c in strata): r["n"] for r in rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, drawn = at_most, {}
    for k, (stratum, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):  # what small strata leave goes to the others
        part = min(n, left // (len(counts) - k))
        left -= part
        drawn[stratum] = (n, (1 << 30) * part // n)
    spark = rows.sparkSession
    if not drawn:
        return rows.limit(0), drawn
    limits = spark.createDataFrame([(*stratum, limit) for stratum, (_, limit) in drawn.items()], spark_schema(rows, strata))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    return rows.join(F.broadcast(limits), strata).where(draw < F.col("__limit")).drop("__limit"), drawn  # a row a stratum


def spark_schema(rows: DataFrame, columns: list[str]):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([rows.schema[c] for c in columns] + [StructField("__limit", LongType())])


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete what keep() wrote, once nothing reads it any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
