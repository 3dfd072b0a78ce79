"""Readers that go on after a damaged line and say where it is.

Files are read by Spark's own text source, in splits, so that a file of any size is many tasks.  A line's number is the number of lines in the splits of its
file before its own, and its place in its split: one count a split is all that tasks need of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.operators.answerkey import named
from tallyroom.sources.room import CLASSIFIED, RoomError, table_rows, text_of

#: Row numbers that Spark gives inside one task take so many bits.
TASK_BITS = 33


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines count), value of text files."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))
    task, place = F.shiftright("id", TASK_BITS), F.col("id").bitwiseAND((1 << TASK_BITS) - 1)
    splits = raw.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "begin", "first", before.alias("before"))  # a row a split
    return raw.withColumn("task", task).withColumn("place", place).join(starts, ["file", "begin"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def _judge(rows: DataFrame, where: str) -> DataFrame:
    """Adds the faults of rows that were read: no path, or a path that comes again (the first row of it is sound)."""
    again = rows.where("error IS NULL AND source_path <> ''").groupBy("source_path").agg(F.min(where).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("source_path", "_first")
    told = rows.join(again, "source_path", "left")
    fault = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("source_path", F.lit("")) == "", "no source_path").when(F.col(where) > F.col("_first"), F.concat(F.lit("classified twice, first at "), F.col("_first").cast("string")))
    return told.withColumn("error", fault).drop("_first")


def classified_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, record columns, room_hash, error of a file with one JSON object a line; blank lines are passed over.

    ``error`` is null for a row that can be used; else it says what is wrong with this line, and the others are read all the same."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    kind = f"{CLASSIFIED}, room_hash string, _bad string"
    parsed = lines.select("line", "value", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    error = F.when(~F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull(), "not an object").when(F.try_parse_json("value").isNull(), "not valid JSON").when(F.col("r._bad").isNotNull(), "a field of the wrong kind")
    return _judge(parsed.select("line", "r.*", error.alias("error")).drop("_bad"), "line")


def classified_file(spark: SparkSession, path: str) -> DataFrame:
    """The same of a JSON object with the list ``classifications``; ``line`` is the record's place in it, from 0."""
    record = ", ".join(x.replace(" ", ": ", 1) for x in CLASSIFIED.split(", "))
    raw = spark.read.schema(f"tool string, room_hash string, classifications array<struct<{record}>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    head = raw.select(F.col("_bad").isNotNull().alias("bad"), F.size("classifications").alias("n")).take(1)
    if not head or head[0]["bad"]:
        raise RoomError(f"{path}: no JSON object with a list of classifications")
    if (head[0]["n"] or 0) < 1:
        raise RoomError(f"{path}: no classifications; a tool that skipped every document says so with unsure records")
    rows = raw.select("room_hash", F.posexplode("classifications").alias("line", "c"))
    return _judge(rows.select(F.col("line").cast("long").alias("line"), "c.*", "room_hash", F.when(F.col("c").isNull(), "not an object").alias("error")), "line")


def classified(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a classification, by the name's ending: .json is one object, anything else has a record a line."""
    return (classified_file if path.lower().endswith(".json") else classified_lines)(spark, path)


def faults(rows: DataFrame, shown: int = 10) -> DataFrame:
    """error, n, named: each kind of fault with the lines that have it."""
    kind = F.regexp_replace("error", r"(classified twice).*", "$1")
    return named(rows.where("error IS NOT NULL").select(kind.alias("error"), F.col("line").alias("at")), "error", "at", shown)


def sound(rows: DataFrame, path: str) -> DataFrame:
    """The rows, or an error that names the damaged lines; a file without records is an error."""
    if told := faults(rows).orderBy("error").collect():
        raise RoomError(f"{path}: " + "; ".join(f"{r['error']}: {r['n']} (at {r['named']})" for r in told))
    if rows.isEmpty():
        raise RoomError(f"{path}: no records")
    return rows.drop("error")


def key_rows(spark: SparkSession, path: str) -> DataFrame:
    """line, source_path, document_type, primary_workstream, secondary_workstreams of a key on disk."""
    return sound(classified_lines(spark, path), path).select("line", "source_path", "document_type", "primary_workstream", "secondary_workstreams")


FIGURES = "Canonical figures"


def figure_rows(text: Column) -> Column:
    """The cells of all figure tables of a fact sheet."""
    return table_rows(text, FIGURES)


def figures_fault(sheets: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fault``: why a fact sheet declares no figures, null where it declares some or has no such heading."""
    headed = F.lower(F.concat(F.lit("\n"), text)).rlike(r"\n\s*## canonical figures")
    rows = figure_rows(F.col(text))
    wide = lambda c: F.size(c) >= 3
    figure = lambda c: F.lower(F.trim(F.get(c, F.lit(0)))) != "key"
    fault = (
        F.when(~headed | F.exists(rows, lambda c: wide(c) & figure(c)), None)
        .when(F.size(rows) == 0, "a heading without a table")
        .when(F.size(F.get(rows, F.lit(0))) < 3, "a header of fewer than three columns")
        .when(~F.exists(rows, figure), "a header without rows")
        .otherwise("rows of fewer than three columns")
    )
    return sheets.withColumn("fault", fault)
