"""What the corpus operators share: the scratch folder, sizes, row slices."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles; a longer single text is handled alone.
STEP_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session of one machine that names none gets a temporary folder; on a cluster that is an
    error, as executors don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Spark setting: a finished query's shuffle files go at once.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    Its shuffle files are removed once it is written, itself when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(*written: DataFrame) -> None:
    """Delete what ``scratch`` wrote, once nothing reads it any more."""
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, at = _fs(df.sparkSession, path)
            fs.delete(at, True)


def groups_for(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES):
    """Cut a batch into runs of rows with about ``most`` text bytes each."""
    text = batch.column(column)
    size = [len(x) if x is not None else 0 for x in text.cast(pa.binary()).to_pylist()] if batch.num_rows < 2 else None
    if size is not None:
        yield batch
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


#: Bucket numbers that ``may_match`` broadcasts at most, whatever the data.
BUCKETS = 1 << 20


def may_match(rows: DataFrame, number, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a partner in ``wanted``, and rows that surely have none.

    ``wanted`` has one column; a row's ``number`` (a Column of that type) is compared by bucket
    number only, so the broadcast table has at most BUCKETS rows. Only the first part then needs
    a join with an exchange.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    table = F.broadcast(wanted.select(bucket(F.col(wanted.columns[0])).alias("_bucket")).distinct())
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), bucket(number).alias("_bucket"))
    part = lambda how: whole.join(table, "_bucket", how).select("row.*")
    return part("left_semi"), part("left_anti")


def packed(rows: DataFrame) -> DataFrame:
    """One column ``row`` with all of them, so that no working column has the name of one; ``select("row.*")`` undoes it."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
