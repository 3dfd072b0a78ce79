"""Reading tables and keeping intermediate tables on shared storage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_marked: set[str] = set()
#: Rows of a file of a narrow table.
FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared one.  It goes when the application ends.

    Where no shared folder is named, as in tests, a local one does for a local master; executors of a cluster would not see it."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/tallyroom/{context.applicationId}"
    if path not in _marked:
        _marked.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return path


def kept(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to a new table in the shared folder and read it again.

    The table survives the loss of any executor.  ``rows`` is a bound of its rows, if one is known: a small table is then
    written as a few files (a core's worth each, or ``FILE_ROWS`` rows) instead of one a shuffle partition."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, label: str, rows: int | None = None, **what: Column) -> tuple[DataFrame, dict]:
    """``kept`` and the sums ``what`` of its rows, taken as they are written: no job of its own reads them again."""
    seen = Observation()
    out = kept(df.observe(seen, *(c.alias(k) for k, c in what.items())), label, rows)
    return out, seen.get


def counted(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """``kept`` and the number of its rows."""
    out, seen = observed(df, label, rows, n=F.count("*"))
    return out, seen["n"]


def drop(df: DataFrame) -> None:
    """Delete the table that ``kept`` gave as ``df``.  Only for tables that nothing reads any more: not that by which an executor's loss is mended."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.startswith(("file:", "hdfs:")) or "/tallyroom/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_kept(spark: SparkSession) -> None:
    """Delete every table that ``kept`` has written in this application.  Frames made from them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct named row, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")


def followed(df: DataFrame, columns: str) -> T.StructType:
    """The schema of ``df`` and ``columns`` after it."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(columns).fields])
