"""Names that have to be checked: those a fact sheet declares, its cast, and entities in its prose.

Fact sheets: (rel_path, text).  A sheet's tables belong to the heading above them, which is carried down the lines; a heading that does not match ends
a table, a later one that does begins another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators.ranks import carried

#: Fixed values.
KINDS = ("entity", "brand", "product", "site", "domain", "person")
VERDICTS = ("clear", "collision", "ambiguous", "unchecked")
DECLARED, CAST = "## invented names", "## cast"


def headed_lines(sheets: DataFrame) -> DataFrame:
    """rel_path, pos, line, heading: each line with the last heading of level two or deeper at it or above it, in lower case."""
    lines = sheets.select("rel_path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    return carried(lines.withColumn("_h", F.when(F.col("line").startswith("##"), F.lower("line"))), "_h", "pos", by=("rel_path",), name="heading").drop("_h")


def table_cells(lines: DataFrame, heading: str) -> DataFrame:
    """rel_path, pos, cells of the data rows below headings that begin so; headers (first cell "Name" or empty) and rulers are none."""
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.col("heading").startswith(heading) & F.col("line").startswith("|")).select("rel_path", "pos", cells.alias("cells"))
    return rows.where((F.col("cells")[0] != "") & (F.lower(F.col("cells")[0]) != "name") & ~F.col("cells")[0].rlike(r"^[-:]+$"))


def candidates(sheets: DataFrame) -> DataFrame:
    """rel_path, name, kind, fault: each name once a sheet.  A declared kind comes before "entity", which comes before a place in the cast.

    ``fault`` says why a declaration cannot stand (no kind, an unknown one, two different ones, or not "person" for a name in the cast); all comes from one aggregate."""
    lines = headed_lines(sheets)
    declared = table_cells(lines, DECLARED).where("size(cells) >= 2").select("rel_path", F.col("cells")[0].alias("name"), F.lower(F.col("cells")[1]).alias("kind"), F.lit(3).alias("by"))
    cast = table_cells(lines, CAST).select("rel_path", F.col("cells")[0].alias("name"), F.lit("person").alias("kind"), F.lit(1).alias("by"))
    prose = sheets.select("rel_path", F.explode(T.entity_tokens(F.col("text"))).alias("name"), F.lit("entity").alias("kind"), F.lit(2).alias("by"))
    said = F.when(F.col("by") == 3, F.col("kind"))
    told = declared.union(cast).union(prose).groupBy("rel_path", "name").agg(
        F.max_by("kind", F.struct("by", "kind")).alias("kind"), F.min(said).alias("low"), F.max(said).alias("high"), F.max(F.col("by") == 1).alias("cast"),
        F.max(F.coalesce(~said.isin(*KINDS), F.lit(False))).alias("unknown"))
    fault = F.when(F.col("low") == "", "no kind").when(F.col("unknown"), "unknown kind").when(F.col("low") != F.col("high"), "two kinds").when(F.col("cast") & (F.col("high") != "person"), "in the cast, but not declared a person")
    return told.select("rel_path", "name", "kind", fault.alias("fault"))


def malformed(name: Column) -> Column:
    """Whether a name is one word, or a corporate suffix: masking it would mask every name that ends so."""
    suffix = [x.lower() for x in (*T.SUFFIXES, *T.CAPITALISED_SUFFIXES, *T.EXACT_SUFFIXES)]
    return (F.size(T.tokens(name)) < 2) | F.lower(F.trim(name)).isin(*suffix)


def unwritable(verdicts: DataFrame) -> DataFrame:
    """(name, fault) of name-check rows (name, kind, verdict, checked, note) that would not be read back as they are, or must not be written."""
    torn = F.coalesce(F.col("name").rlike(r"[|\r\n]") | (F.trim("name") != F.col("name")) | (F.col("name") == "") | (F.lower("name") == "name") | F.col("name").rlike(r"^[-:]+$"), F.lit(True))
    fault = F.when(torn, "does not survive the table").when(F.coalesce(~F.col("verdict").isin(*VERDICTS), F.lit(True)), "unknown verdict").when((F.col("kind") == "entity") & malformed(F.col("name")), "an entity of one word")
    return verdicts.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def name_check_lines(verdicts: DataFrame) -> DataFrame:
    """(name, line): the rows of a name-check table; bars in notes become slashes."""
    note = F.replace(F.regexp_replace(F.coalesce("note", F.lit("")), r"\s+", " "), F.lit("|"), F.lit("/"))
    return verdicts.select("name", F.concat(F.lit("| "), F.concat_ws(" | ", "name", "kind", "verdict", "checked", note), F.lit(" |")).alias("line"))
