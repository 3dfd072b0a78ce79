"""Ordinals, apportionment, identifiers and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyroom.operators.ranks import ranked

#: Severities and their shares.
SEVERITY_SHARES = (("critical", 1), ("high", 3), ("medium", 4), ("low", 3))
SIZES = {"XS": (40, 4, 2), "S": (60, 12, 5), "M": (200, 25, 10), "L": (800, 60, 18), "XL": (2000, 90, 25)}


def apportioned(rows: DataFrame, total: int, weight: str = "weight", tie: str = "number", floor: int = 1) -> DataFrame:
    """Adds ``count``: ``floor`` each, the rest of ``total`` in proportion to integer weights by largest remainders, ties to the lower ``tie``."""
    every = Window.partitionBy()  # a dimension table: sections of a plan
    order = Window.orderBy(F.desc("_rest"), tie)
    n, all_w = F.count("*").over(every), F.sum(weight).over(every)
    share = (F.lit(total) - floor * n) * F.col(weight)
    df = rows.withColumn("_whole", F.floor(share / all_w).cast("long")).withColumn("_rest", share % all_w)
    short = (F.lit(total) - floor * n - F.sum("_whole").over(every)).alias("_short")
    df = df.select("*", short).withColumn("_rank", F.row_number().over(order))
    return df.withColumn("count", (F.lit(floor) + F.col("_whole") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)).cast("long")).drop("_whole", "_rest", "_short", "_rank")


def slot_manifest(sections: DataFrame) -> DataFrame:
    """One row per slot of sections (number, dir_name, subsections array, count): slot_id, tier, rel_path.

    Positions go round the subsections; the first 35 hundredths (half-even, one at least) are tier A."""
    pos = sections.where("count > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("position"))
    subs = F.size("subsections")
    sub, ordinal = (F.col("position") % subs).cast("int"), (F.floor(F.col("position") / subs) + 1).cast("int")
    name = F.get("subsections", sub)
    anchors = F.greatest(F.lit(1), F.bround(F.col("count") * 0.35))
    slot = F.format_string("%d.%d.%d", "number", sub + 1, ordinal)
    path = F.concat("dir_name", F.lit("/"), F.format_string("%d.%d_%s", "number", sub + 1, name), F.lit("/"), slot, F.lit("_"), name, F.lit("-"), F.format_string("%02d", ordinal), F.lit(".md"))
    return pos.select("number", (sub + 1).alias("sub"), ordinal.alias("ordinal"), slot.alias("slot_id"), F.when(F.col("position") < anchors, "A").otherwise("F").alias("tier"), path.alias("rel_path"))


def authoring_order(slots: DataFrame, load_bearing: DataFrame, house_forms: DataFrame, position: str = "position") -> DataFrame:
    """Adds ``rank``: house forms first, then load-bearing paths, then tier A, else as they stand, by ranges of that order."""
    mark = lambda df, name: df.select("rel_path").distinct().withColumn(name, F.lit(0))
    df = slots.join(mark(house_forms, "_h"), "rel_path", "left").join(mark(load_bearing, "_l"), "rel_path", "left")
    df = df.withColumn("_h", F.coalesce("_h", F.lit(1))).withColumn("_l", F.coalesce("_l", F.lit(1))).withColumn("_t", F.when(F.col("tier") == "A", 0).otherwise(1))
    return ranked(df, "_h", "_l", "_t", position).withColumn("rank", F.col("rank").cast("int")).drop("_h", "_l", "_t")


def budget_batches(rows: DataFrame, by: list[str], order: str, item: str, weight: str, budget: int, max_batches: int | None = None) -> DataFrame:
    """(by, item, batch): rows in order (ties by item), packed into batches of at most ``budget``; one heavier than that goes alone; what is
    beyond ``max_batches`` is left out.

    A batch depends on all before it in its group, so each group of ``by`` is one sorted stream, of which only the running load and number are held."""
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([*(StructField(c, fields[c]) for c in by), StructField(item, fields[item]), StructField("batch", IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, load, batch = None, 0, 0
        for pdf in frames:
            out = []
            for row in zip(*(pdf[c] for c in by), pdf["_w"]):
                key, w = tuple(None if x != x else x for x in row[:-1]), int(row[-1])
                if key != group:
                    group, load, batch = key, 0, 0
                elif load > 0 and load + w > budget:
                    load, batch = 0, batch + 1
                load += w
                out.append(batch)
            yield pdf[[*by, item]].assign(batch=pd.Series(out, pdf.index, "int32"))

    streams = rows.select(*by, item, F.col(order).alias("_o"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("_w")).repartition(*by).sortWithinPartitions(*by, "_o", item)
    out = streams.drop("_o").mapInPandas(run, schema)
    return out.where(F.col("batch") < max_batches) if max_batches else out


def severity_targets(totals: DataFrame, total: str = "total") -> DataFrame:
    """total, severity, target: each total (four at least, else it has no rows) shared out by the fixed shares with largest remainders; then every band has one, taken from the largest (of equals that of the smaller share, then the more severe).

    A row's bands are an array of four, so each total is worked on by itself.  The remainders leave one band empty at most, that of the smallest share."""
    whole = sum(w for _, w in SEVERITY_SHARES)
    n = F.col(total)
    bands = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(i).alias("place"), F.lit(w).alias("share"), F.floor(n * w / whole).cast("int").alias("target"), (n * w % whole).cast("int").alias("rest")) for i, (s, w) in enumerate(SEVERITY_SHARES)))
    rows = totals.where(n >= len(SEVERITY_SHARES)).select(total, bands.alias("b"))
    rows = rows.withColumn("short", F.col(total) - F.aggregate("b", F.lit(0), lambda a, x: a + x["target"]))
    by_rest = F.array_sort(F.transform("b", lambda x: F.struct((-x["rest"]).alias("r"), (-x["share"]).alias("w"), x["severity"].alias("severity"), x["place"].alias("place"), x["target"].alias("target"))))
    rows = rows.select(total, F.transform(by_rest, lambda x, i: F.struct((x["target"] + F.when(i < F.col("short"), 1).otherwise(0)).alias("target"), x["w"].alias("w"), (-x["place"]).alias("place"), x["severity"].alias("severity"))).alias("b"))
    lacking = F.size(F.filter("b", lambda x: x["target"] == 0))
    most = F.array_max(F.transform("b", lambda x: F.struct(x["target"].alias("target"), x["w"].alias("w"), x["place"].alias("place"), x["severity"].alias("severity"))))["severity"]
    given = F.transform("b", lambda x: F.struct(x["severity"].alias("severity"), F.when(x["target"] == 0, 1).when(x["severity"] == most, x["target"] - lacking).otherwise(x["target"]).alias("target")))
    return rows.select(total, F.explode(given).alias("x")).select(F.col(total).cast("int").alias("total"), "x.severity", "x.target")


def allocated_ids(discoveries: DataFrame, existing: DataFrame) -> DataFrame:
    """provisional_id, finding_id: the next numbers of each prefix, in order of label and provisional id.
    Discoveries: label, provisional_id, prefix.  Existing: finding_id."""
    most = existing.select(F.regexp_extract("finding_id", r"^(.+)-([0-9]+)$", 1).alias("prefix"), F.regexp_extract("finding_id", r"^(.+)-([0-9]+)$", 2).cast("long").alias("n")).where("n IS NOT NULL").groupBy("prefix").agg(F.max("n").alias("most"))
    numbered = ranked(discoveries, "label", "provisional_id", by=("prefix",), name="k").join(most, "prefix", "left")
    return numbered.select("provisional_id", F.concat("prefix", F.lit("-"), (F.coalesce("most", F.lit(0)) + F.col("k")).cast("string")).alias("finding_id"))


def house_families(slots: DataFrame, least: int = 3) -> DataFrame:
    """Adds ``house``: in (section, subsection) groups of ``least`` members, the path of the first by number."""
    w = Window.partitionBy("section", "subsection")
    return slots.withColumn("_n", F.count("*").over(w)).withColumn("_first", F.min_by("rel_path", "ordinal").over(w)).withColumn("house", F.when(F.col("_n") >= least, F.col("_first"))).drop("_n", "_first")
