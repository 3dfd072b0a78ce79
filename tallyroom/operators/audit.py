"""Audits of a document set: leaks, figures, references, depth, repetition, twins, hashes.

Documents: (rel_path, text).  Small tables (needles, patterns, names) are joined by equality wherever a word of theirs allows it; what
must look into texts is checked after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators.ranks import ranked


def content_hash(files: DataFrame, by: list[str] | None = None, path: str = "rel_path", content: str = "content") -> DataFrame:
    """One hash (a group): sha256 over the sorted lines ``path NUL sha256(content)``, and the count."""
    line = F.concat(F.col(path).cast("string"), F.lit("\0"), F.sha2(F.col(content).cast("binary"), 256))
    return files.groupBy(*(by or [])).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("content_hash"), F.count("*").alias("documents"))


def literal_sweep(docs: DataFrame, needles: list[str], pattern: str | None = None) -> DataFrame:
    """(rel_path, needle): texts or file names that hold a needle in any case, once a needle; ``pattern`` adds its first match."""
    low = F.concat_ws("\n", F.lower("text"), F.lower("rel_path"))
    found = F.filter(F.array(*(F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in needles)), lambda x: x.isNotNull())
    if pattern:
        match = F.regexp_extract("text", f"({pattern})", 1)
        found = F.concat(found, F.when(match != "", F.array(match)).otherwise(F.array().cast("array<string>")))
    return docs.select("rel_path", F.explode(found).alias("needle"))


def containment(docs: DataFrame, needles: DataFrame, hay: str = "text", needle: str = "needle", isolated: bool = False) -> DataFrame:
    """Pairs of a document and a needle that its text holds.

    Needles are looked up by their rarest inner run of letters and digits (a run with a neighbour on both sides
    in the needle stands as a whole run in any text that holds it), so texts and needles meet by equality, and only
    candidates are searched, each text once for all of its candidates.  Needles without such a run are looked up by ``_bare``."""
    runs = lambda c: F.filter(F.split(c, r"[^\p{Nd}\p{L}]+"), lambda r: r != "")
    edge = lambda c: F.concat(F.lit(" "), c, F.lit(" ")) if isolated else c
    inner = F.filter(F.regexp_extract_all(edge(F.col(needle)), F.lit(r"(?<=[^\p{Nd}\p{L}])[\p{Nd}\p{L}]+(?=[^\p{Nd}\p{L}])"), 0), lambda r: r != "")
    keyed = needles.withColumn("_runs", F.array_distinct(inner))
    words = docs.select("rel_path", F.explode(F.array_distinct(runs(F.col(hay)))).alias("_run"))
    offered = keyed.select(needle, F.explode("_runs").alias("_run"))
    wanted = offered.select("_run").distinct()
    present = words.join(wanted, "_run", "left_semi")
    counts = present.groupBy("_run").agg(F.count("*").alias("_df"))
    rare = offered.join(counts, "_run", "left").groupBy(needle).agg(F.min_by("_run", F.struct(F.coalesce("_df", F.lit(0)), F.col("_run"))).alias("_run"))
    near = present.join(rare, "_run").select("rel_path", needle)
    bare = keyed.where((F.size("_runs") == 0) & (F.col(needle) != "")).select(needle)
    if not bare.isEmpty():
        near = near.union(_bare(docs, bare, hay, needle))
    check = lambda n: T.isolated(F.col(hay), n) if isolated else F.contains(F.col(hay), n)
    offers = near.groupBy("rel_path").agg(F.collect_set(needle).alias("_offers"))
    return docs.select("rel_path", hay).join(offers, "rel_path").select("rel_path", F.explode(F.filter("_offers", check)).alias(needle)).distinct()


def _bare(docs: DataFrame, needles: DataFrame, hay: str, needle: str) -> DataFrame:
    """Candidates (rel_path, needle) for needles that may stand inside a longer word.

    Texts are pieces: runs of letters and digits, and what is between them.  A needle's longest piece is part of a piece of any text that holds the needle; those pieces are
    found among all different ones by their first three characters at any place, and then their texts by equality."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{Nd}\p{L}]+|[^\p{Nd}\p{L}]+"), 0)
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    longest = F.array_max(F.transform(pieces(F.col(needle)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    wanted = needles.select(needle, longest.alias("_part")).withColumn("_gram", F.left("_part", F.lit(3)))
    held = docs.select("rel_path", F.explode(F.array_distinct(pieces(F.col(hay)))).alias("_piece"))
    different = held.select("_piece").distinct()
    offered = different.select("_piece", F.explode(F.array_distinct(F.concat(*(grams(F.col("_piece"), n) for n in (1, 2, 3))))).alias("_gram"))
    near = offered.join(wanted, "_gram").where(F.contains("_piece", F.col("_part"))).select("_piece", needle).distinct()
    return held.join(near, "_piece").select("rel_path", needle).distinct()


def cross_references(docs: DataFrame, slots: DataFrame, gaps: list[str] | None = None) -> DataFrame:
    """(rel_path, ref): slot-shaped references that no slot, allowed gap or the document's own slot explains."""
    own = F.element_at(F.split(F.element_at(F.split("rel_path", "/"), -1), "_"), 1)
    refs = docs.select("rel_path", own.alias("own"), F.explode(T.slot_refs(F.col("text"))).alias("ref")).where("ref <> own")
    if gaps:
        refs = refs.where(~F.col("ref").isin(*gaps))
    return refs.join(slots.select(F.col("slot_id").alias("ref")), "ref", "left_anti").select("rel_path", "ref")


def contradictions(figures: DataFrame) -> DataFrame:
    """(key, old) of superseded values that stand, by themselves, inside the current value (key, value, superseded) of their own key: no text can have the one without the other."""
    return figures.select("key", "value", F.explode("superseded").alias("old")).where(T.isolated(F.col("value"), F.col("old"))).select("key", "old")


def checked_references(docs: DataFrame, slots: DataFrame, section_numbers: DataFrame, gaps: list[str] | None = None) -> DataFrame:
    """(rel_path, ref, problem) of slot-shaped references that are no clause numbers: "out of range" where no section has their number (number), "dangling"
    where one has but no slot, allowed gap or the document's own slot explains them."""
    own = F.element_at(F.split(F.element_at(F.split("rel_path", "/"), -1), "_"), 1)
    placed = docs.select("rel_path", own.alias("own"), F.explode(T.refs_in_place(F.col("text"))).alias("x"))
    refs = placed.where(~T.is_clause_number(F.col("x.left"))).select("rel_path", "own", "x.ref", F.split_part("x.ref", F.lit("."), F.lit(1)).cast("int").alias("number")).distinct()
    judged = refs.join(section_numbers.select("number", F.lit(True).alias("_section")).distinct(), "number", "left").join(slots.select(F.col("slot_id").alias("ref"), F.lit(True).alias("_slot")).distinct(), "ref", "left")
    known = (F.col("ref") == F.col("own")) | F.col("_slot").isNotNull() | F.col("ref").isin(*(gaps or []))
    problem = F.when(F.col("_section").isNull(), "out of range").when(~known, "dangling")
    return judged.select("rel_path", "ref", problem.alias("problem")).where("problem IS NOT NULL")


def depth_lint(docs: DataFrame, floor: Column, listed=T.PLACEHOLDERS) -> DataFrame:
    """rel_path, words, floor, problem: 'placeholder' comes before 'short'; null where there is none."""
    said = docs.select("rel_path", T.wordcount(F.col("text")).alias("words"), floor.alias("floor"), T.placeholder(F.col("text"), listed).alias("token"))
    return said.select("rel_path", "words", "floor", F.when(F.col("token").isNotNull(), "placeholder").when(F.col("words") < F.col("floor"), "short").alias("problem"))


def archetypes(docs: DataFrame, patterns: DataFrame, default: str) -> DataFrame:
    """rel_path, archetype: of the longest pattern (pattern, archetype, floor) in the file's name, ties to the higher floor.

    The name's pieces of the patterns' lengths (few numbers) are looked up by equality in the patterns, a room's table, which goes to every task; a name without any is
    in the same grouping, so that documents are never joined with documents."""
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    lengths = patterns.select(F.length("pattern").alias("n")).where("n > 0").distinct()
    pieces = docs.select("rel_path", name.alias("name")).distinct()
    sizes = sorted(r["n"] for r in lengths.collect())  # at most as many as a file name has characters
    places = lambda n: F.sequence(F.lit(1), F.length("name") - n + 1)
    pieces_of = lambda n: F.transform(places(n), lambda i: F.substr(F.col("name"), i, F.lit(n)))
    cuts = [F.when(F.length("name") >= n, pieces_of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    offered = pieces.select("rel_path", F.explode(F.array_distinct(F.flatten(F.array(*cuts)))).alias("pattern")) if cuts else pieces.select("rel_path", F.lit("").alias("pattern")).limit(0)
    found = offered.join(F.broadcast(patterns), "pattern").select("rel_path", F.struct(F.length("pattern").alias("n"), "floor", "archetype").alias("x"))
    every = found.union(docs.select("rel_path", F.lit(None).cast(found.schema["x"].dataType)))
    return every.groupBy("rel_path").agg(F.max("x").alias("x")).select("rel_path", F.coalesce("x.archetype", F.lit(default)).alias("archetype"))


def floors(slots: DataFrame, archetype: DataFrame, of_archetype: DataFrame, flat: int, band: DataFrame | None = None) -> DataFrame:
    """rel_path, floor: tier F has the flat floor, tier A that of its archetype (archetype, floor), else the flat one; in a long room a slot's
    band (section, subsection, floor) counts where it has one."""
    # slots and their archetypes grow together and are never small; a room's archetypes are
    told = slots.join(archetype.hint("merge"), "rel_path", "left").join(F.broadcast(of_archetype.select("archetype", F.col("floor").alias("_a"))), "archetype", "left")
    floor = F.when(F.col("tier") == "A", F.coalesce("_a", F.lit(flat))).otherwise(F.lit(flat))
    if band is not None:
        told = told.join(band.select("section", "subsection", F.col("floor").alias("_b")), ["section", "subsection"], "left")
        floor = F.coalesce(F.col("_b"), floor)
    return told.select("rel_path", floor.cast("int").alias("floor"))


def repetition(docs: DataFrame, blocks: Column, least_tokens: int = 30) -> DataFrame:
    """rel_path, total, repeated: tokens in all blocks, and in blocks of ``least_tokens`` seen before in the text.
    ``blocks`` is an array of token arrays."""
    long = F.filter(F.col("_b"), lambda b: F.size(b) >= least_tokens)
    keyed = docs.select("rel_path", blocks.alias("_b")).withColumn("_k", F.transform(long, lambda b: F.struct(F.sha2(F.array_join(b, " "), 256).alias("k"), F.size(b).alias("n"))))
    total = F.aggregate("_b", F.lit(0), lambda a, b: a + F.size(b))
    every, once = F.aggregate("_k", F.lit(0), lambda a, x: a + x["n"]), F.aggregate(F.array_distinct("_k"), F.lit(0), lambda a, x: a + x["n"])
    return keyed.select("rel_path", total.alias("total"), (every - once).alias("repeated"))


def distribution(shares: DataFrame, column: str, threshold: float) -> DataFrame:
    return shares.agg(F.count("*").alias("n"), F.percentile(column, 0.5).alias("median"), F.max(column).alias("most"), F.count_if(F.col(column) > threshold).alias("above"))


def twin_diff(blind: DataFrame, flagged: DataFrame, marker: str) -> DataFrame:
    """(rel_path, problem): documents whose flagged twin is missing or differs before its last marker."""
    f = flagged.select("rel_path", F.col("text").alias("_f"))
    body = F.coalesce(T.twin_body(F.col("_f"), marker), F.col("_f"))
    bad = F.when(F.col("_f").isNull(), "missing").when(~((F.col("text") == F.col("_f")) | (F.col("text") == body)), "differs")
    return blind.join(f, "rel_path", "left").select("rel_path", bad.alias("problem")).where("problem IS NOT NULL")


def carrier_census(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(rel_path, problem, finding_ids): blocks that are missing, unexpected, or name other ids than (rel_path, finding_id) expects."""
    e = expected.groupBy("rel_path").agg(F.array_sort(F.collect_set("finding_id")).alias("want"))
    a = actual.groupBy("rel_path").agg(F.array_sort(F.collect_set("finding_id")).alias("have"))
    both = e.join(a, "rel_path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "wrong ids")
    ids = F.when(F.col("have").isNull(), F.col("want")).when(F.col("want").isNull(), F.col("have")).otherwise(F.array_sort(F.array_union(F.array_except("want", "have"), F.array_except("have", "want"))))
    return both.select("rel_path", problem.alias("problem"), ids.alias("finding_ids")).where("problem IS NOT NULL")


def both_ways(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(column, side) of values on one side only."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def stale_rows(expected: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """(key, state): missing, extra or changed rows of a written table; columns are compared null-safely."""
    rest = [c for c in expected.columns if c != key]
    e, d = expected.select(key, F.struct(*rest).alias("_e")), on_disk.select(key, F.struct(*rest).alias("_d"))
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("_e").eqNullSafe(F.col("_d")), "changed")
    return e.join(d, key, "full").select(key, state.alias("state")).where("state IS NOT NULL")


def moved_rows(expected: DataFrame, on_disk: DataFrame, key: str, place: str) -> DataFrame:
    """(key) of rows in both tables that follow another row on disk (by ``place``) than they should (in order of ``key``)."""
    common = on_disk.select(key, place).join(expected.select(key), key)
    both = ranked(ranked(common, key, name="_want"), place, name="_have")
    before = both.select((F.col("_have") + 1).alias("_have"), (F.col("_want") + 1).alias("_due"))
    return both.join(before, "_have", "left").where(F.col("_want") != F.coalesce("_due", F.lit(1))).select(key)


def key_violations(findings: DataFrame, distractors: DataFrame) -> DataFrame:
    """(owner, rule, detail) of every breach inside an answer key."""
    ids = findings.select(F.col("finding_id").alias("link"))
    links = findings.select("finding_id", F.explode("cross_links").alias("link"))
    edges = findings.select("finding_id", F.col("source").alias("path"), F.lit("source").alias("part")).union(findings.select("finding_id", F.explode("corroboration"), F.lit("corroboration")))
    bad_path = (F.col("path") == "") | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    named = lambda df, owner, rule, detail: df.select(F.col(owner).alias("owner"), F.lit(rule).alias("rule"), F.col(detail).alias("detail"))
    n = F.size("corroboration")
    out = [
        named(links.join(ids, "link", "left_anti"), "finding_id", "dangling link", "link"),
        named(links.where("link = finding_id"), "finding_id", "link to itself", "link"),
        named(findings.where(F.col("multi_document") != (n > 0)), "finding_id", "multi-document without corroboration, or the reverse", "source"),
        named(edges.where(bad_path), "finding_id", "bad path", "path"),
        named(findings.where(F.array_contains("corroboration", F.col("source"))), "finding_id", "source listed again", "source"),
        named(findings.where(n > F.size(F.array_distinct("corroboration"))), "finding_id", "corroboration repeats", "source"),
        named(distractors.where("resolution = location"), "distractor_id", "resolution is the location", "location"),
        named(distractors.where("shape_matches IS NOT NULL").join(findings.select(F.col("finding_id").alias("shape_matches")), "shape_matches", "left_anti"), "distractor_id", "dangling shape", "shape_matches"),
        named(distractors.join(edges.select(F.col("path").alias("location")).distinct(), "location", "left_semi"), "distractor_id", "location is evidence", "location"),
    ]
    total = out[0]
    for x in out[1:]:
        total = total.union(x)
    return total


def trailing_phrases(candidates: DataFrame, cast: DataFrame) -> DataFrame:
    """Candidates of two or more words that end a cast name (or are one), Ltd read as Limited and Inc as Incorporated;
    an equality join with every suffix of the cast names."""
    same = lambda w: F.when(w == "ltd", "limited").when(w == "inc", "incorporated").otherwise(w)
    words = lambda c: F.transform(F.filter(F.split(F.lower(c), r"[\s.,]+"), lambda w: w != ""), same)
    tails = cast.select(words(F.col("name")).alias("w")).where(F.size("w") >= 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.size("w")), " "))).alias("key")).distinct()
    return candidates.withColumn("key", F.array_join(words(F.col("candidate")), " ")).join(tails, "key", "left_semi").drop("key")
