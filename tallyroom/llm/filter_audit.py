"""Audit of how document filters interact: what each filter removes, at each place of each order in which they can be applied.

Five failure flags are computed once a document.  Documents are counted by part and flags; SQL's CUBE over the flags and the part gives
the counts of every grouping set, and its rows whose selected flags are all false are the survivors of that subset of filters.
A step of an order goes from one subset to one with a filter more, so its figures are those of a pair of subsets: a join.

The documents are read once, by built-in functions; from then on a row has its flags and a SHA-256 of its text, about 60 bytes.
Filter E (a text that a smaller id has too) needs the least id of each repeated text: one row a text, combined before
the shuffle and written as a table, so that the join to it is of two plain scans, which adaptive execution splits where one text has a
third of the rows.  Behind the count by part and flags, work depends on the number of parts only.

Defined results: a null text is an empty one, and empty texts are equal to each other; a null part is the empty text.  A null id is
neither smaller nor larger than another, so its document never fails E and fails no other; rows of one id that repeat do not fail E for each
other.  A document counts as good or toxic if any row of its id in ``labels`` says so, a null id never.  Texts of any length are worked on whole.
An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.tables import kept

FILTERS = "ABCDE"
#: The words of a text lie between these, and the characters of filter D.
SPACE = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
COUNTS = ("kept", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Filters A to D as conditions under which a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def flagged(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, A, B, C, D, E, good, toxic: a row for each document."""
    text = F.coalesce("text", F.lit(""))
    read = documents.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    rows = kept(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(f) for f, c in failures(F.col("text")).items())), "flags")
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(kept(repeated.select("digest", "first"), "first"), "digest", "left").join(kept(marks, "marks"), "doc_id", "left")
    no = F.lit(False)
    return rows.select("doc_id", "part", *"ABCD", F.coalesce(F.col("first") < F.col("doc_id"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survivors(flags: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i is applied), kept, good, toxic: a row for each part and subset, zeros included."""
    spark = flags.sparkSession
    cells = flags.groupBy("part", *FILTERS).agg(F.count("*").alias("kept"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = spark.sql(
        """SELECT part, A, B, C, D, E, grouping(part) AS all_parts, sum(kept) AS kept, sum(good) AS good, sum(toxic) AS toxic,
                  1 - grouping(A) + 2 * (1 - grouping(B)) + 4 * (1 - grouping(C)) + 8 * (1 - grouping(D)) + 16 * (1 - grouping(E)) AS subset
           FROM {cells} GROUP BY CUBE (part, A, B, C, D, E)""",
        cells=cells,
    )
    passed = cube.where("all_parts = 0 AND NOT (coalesce(A, false) OR coalesce(B, false) OR coalesce(C, false) OR coalesce(D, false) OR coalesce(E, false))")
    found = kept(passed.select("part", F.col("subset").cast("int").alias("subset"), *COUNTS), "survivors")
    every = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def steps(count: int = len(FILTERS)) -> list[tuple[str, int, int, int, int]]:
    """order, step, and the subsets of filters before it, after it, and of its own."""
    out = []
    for order in permutations(range(count)):
        before = 0
        for k, i in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, before, before | 1 << i, 1 << i))
            before |= 1 << i
    return out


def interactions(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, n = documents.sparkSession, len(FILTERS)
    subsets = kept(survivors(flagged(documents, labels, part)), "subsets")
    # the pairs of subsets one filter apart, and in how many orders that filter comes just there
    pairs = sorted({(before, after, own, factorial(bin(before).count("1")) * factorial(n - 1 - bin(before).count("1"))) for _, _, before, after, own in steps()})
    edges = spark.createDataFrame(pairs, "before int, after int, own int, orders long")
    first, then = subsets.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in COUNTS)), subsets.withColumnRenamed("subset", "after")
    lost = first.join(edges, "before").join(then, ["part", "after"])
    lost = kept(lost.select("part", "before", "after", "own", "orders", "kept", *((F.col(f"{c}_before") - F.col(c)).alias(name) for c, name in zip(COUNTS, ("removed", "good_lost", "toxic_lost")))), "pairs")
    full = 2**n - 1
    alone = lost.groupBy("part", "own").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("after") == full, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    orders = spark.createDataFrame(steps(), "filter_order string, step int, before int, after int, own int")
    said = lost.join(orders, ["before", "after", "own"]).join(alone, ["part", "own"])
    return said.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Each order is applied to the documents' failures directly: a document goes at the first step whose filter it fails.
ORACLE = r"""
WITH read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM read
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), flags AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM worded LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
    CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), places AS (
  SELECT *, CASE WHEN failed = '' THEN 6 ELSE list_min(list_transform(string_split(failed, ''), lambda x: instr(filter_order, x))) END AS gone
  FROM cells CROSS JOIN orders
), steps AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS x,
    sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
    sum(n) FILTER (gone < step AND contains(failed, substr(filter_order, step, 1))) AS redundant,
    sum(n) FILTER (failed = substr(filter_order, step, 1)) AS unique_fails,
    sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM steps
"""
