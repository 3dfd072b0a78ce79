"""House forms and the contracts derived from them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tallyroom.functions import text as T
from tallyroom.operators.order import house_families

LEAST_DEVIATIONS = 2


def families(slots: DataFrame, lengths: DataFrame, least: int = 3) -> DataFrame:
    """rel_path, house: slots (rel_path, section, subsection, ordinal) of subfolders whose papers are the target's own and that have ``least`` of them; the first by number is the form of all."""
    own = slots.join(lengths.where("paper = 'target'").select("section", "subsection").distinct(), ["section", "subsection"], "left_semi")
    return house_families(own, least).where("house IS NOT NULL").select("rel_path", "house")


def pairs(family: DataFrame, docs: DataFrame) -> DataFrame:
    """rel_path, house_text, text of derived slots that are written, as is their form."""
    derived = family.where("rel_path <> house").join(docs.select("rel_path", "text"), "rel_path")
    return derived.join(docs.select(F.col("rel_path").alias("house"), F.col("text").alias("house_text")), "house").select("rel_path", "house_text", "text")


def _paragraphs(text: str) -> Column:
    """Blocks between blank lines, white space in them as one blank: an array of their keys, and of whether they are standard, having no blank to fill."""
    blocks = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")
    return F.transform(blocks, lambda p: F.struct(F.sha2(p, 256).alias("key"), (F.size(T.blanks(p)) == 0).alias("standard")))


@F.pandas_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("i", "j", "n")])))
def _alike(house: pd.Series, derived: pd.Series) -> pd.Series:
    """The standard library's alignment of each pair of arrays; its last block, of no length, stands at both ends."""
    return pd.Series([[{"i": m.a, "j": m.b, "n": m.size} for m in SequenceMatcher(None, list(a), list(b), autojunk=False).get_matching_blocks()] for a, b in zip(house, derived)], dtype=object)


def aligned(house: Column, derived: Column) -> Column:
    """Blocks (i, j, n) of n equal keys, from i (of 0) in the form and from j in the derived array, in the same order in both; then one of no length at both ends.

    The longest block comes first (of equals the earliest in the form, then in the derived array), then those of what lies before it, and behind it.  What is found
    depends on what was found before, as many times as a text has blocks, so a pair is aligned where its row is and not in rounds over all."""
    return _alike(house, derived)


def deviations(texts: DataFrame) -> DataFrame:
    """rel_path, n of (rel_path, house_text, text): paragraphs in which a derived text departs from its form: standard ones edited or gone, and added ones.

    A paragraph with a blank is there to be filled, so what became of it is no departure; nor is a paragraph beside an edited one, as long as there are no more than were there."""
    cut = texts.select("rel_path", _paragraphs("house_text").alias("_house"), _paragraphs("text")["key"].alias("_derived"))
    found = cut.select("rel_path", F.col("_house.standard").alias("_standard"), aligned(F.col("_house.key"), F.col("_derived")).alias("_blocks"))
    end = lambda k, side: F.coalesce(F.get("_blocks", k - 1)[side] + F.get("_blocks", k - 1)["n"], F.lit(0))
    lost = lambda x, k: F.size(F.filter(F.slice("_standard", end(k, "i") + 1, x["i"] - end(k, "i")), lambda s: s))
    added = lambda x, k: F.greatest((x["j"] - end(k, "j")) - (x["i"] - end(k, "i")), F.lit(0))
    return found.select("rel_path", F.aggregate(F.transform("_blocks", lambda x, k: lost(x, k) + added(x, k)), F.lit(0), lambda a, n: a + n).alias("n"))


def blanks_left(house_text: Column, text: Column) -> Column:
    """The form's blanks that the derived text still has."""
    return F.array_sort(F.filter(T.blanks(house_text), lambda b: F.contains(text, b)))


def problems(texts: DataFrame, least: int = LEAST_DEVIATIONS) -> DataFrame:
    """rel_path, problem of derived texts (rel_path, house_text, text): blanks left, and too few deviations."""
    told = texts.select("rel_path", F.size(blanks_left(F.col("house_text"), F.col("text"))).alias("left")).join(deviations(texts), "rel_path")
    said = F.array_compact(F.array(F.when(F.col("left") > 0, F.lit("blanks left")), F.when(F.col("n") < least, F.lit("too few deviations"))))
    return told.select("rel_path", F.explode(said).alias("problem"))


def form_problems(family: DataFrame, docs: DataFrame, evidence: DataFrame, least: int = LEAST_DEVIATIONS) -> DataFrame:
    """rel_path, problem of a room's house forms: evidence on a form, a form without blanks, and the ``problems`` of texts derived from them."""
    forms = family.select(F.col("house").alias("rel_path")).distinct()
    on_form = forms.join(evidence.select("rel_path").distinct(), "rel_path", "left_semi").select("rel_path", F.lit("evidence on a house form").alias("problem"))
    bare = docs.join(forms, "rel_path", "left_semi").where(F.size(T.blanks(F.col("text"))) == 0).select("rel_path", F.lit("no blanks"))
    return on_form.union(bare).union(problems(pairs(family, docs), least))


def ready(slots: DataFrame, done: DataFrame) -> DataFrame:
    """Slots (rel_path, house) whose form is written (or that have none), not yet done themselves."""
    open_ = slots.join(done, "rel_path", "left_anti")
    own = open_.where("house IS NULL OR house = rel_path")
    return own.union(open_.where("house IS NOT NULL AND house <> rel_path").join(done.select(F.col("rel_path").alias("house")), "house", "left_semi").select(*open_.columns))


def seeded(slots: DataFrame, present: DataFrame) -> DataFrame:
    """(rel_path, house) of derived slots that are not there yet and begin as copies of their form."""
    return slots.where("house IS NOT NULL AND house <> rel_path").join(present, "rel_path", "left_anti").select("rel_path", "house")


def page_stats(pages: DataFrame, floors: DataFrame) -> DataFrame:
    """band, n, least, median, most, below: rendered pages (band, pages) against each band's floor (band, floor)."""
    return pages.join(floors, "band").groupBy("band").agg(F.count("*").alias("n"), F.min("pages").alias("least"), F.percentile("pages", 0.5).alias("median"), F.max("pages").alias("most"), F.count_if(F.col("pages") < F.col("floor")).alias("below"))


def scan_pages(docs: DataFrame, scanned: DataFrame, words_per_page: int = 500) -> DataFrame:
    """pages of the scanned slots at a number of words a page, one a document at least."""
    n = F.greatest(F.lit(1), F.ceil(T.wordcount(F.col("text")) / words_per_page))
    return docs.join(scanned, "slot_id", "left_semi").agg(F.coalesce(F.sum(n), F.lit(0)).alias("pages"))


def part_words(docs: DataFrame) -> DataFrame:
    """rel_path, part, words: words below each level-2 heading."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), "text"), r"\n## "), lambda p: F.lit(True))
    return docs.select("rel_path", F.posexplode(parts).alias("pos", "p")).where("pos > 0").select("rel_path", F.trim(F.element_at(F.split("p", "\n"), 1)).alias("part"), T.wordcount(F.regexp_replace("p", r"^[^\n]*\n?", "")).alias("words"))
