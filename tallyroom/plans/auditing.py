"""Queries of the audits over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import audit as A

TOKENS = ("password", "licensed under", "token =", "@mail")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("rel_path"), "text", "lang", "source", "n_chars")


def _twins(s, d):
    """Documents and their flagged copies: every 5th has a block, every 50th of them differs before it, every 77th is missing."""
    docs = _docs(s, d)
    body = F.when(F.col("rel_path") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    block = F.concat(F.lit("\n## FLAG\n- **F-"), (F.col("rel_path") % 9).cast("string"), F.lit(" (title)** body\n"))
    flagged = docs.where("rel_path % 77 <> 0").select("rel_path", F.when(F.col("rel_path") % 5 == 0, F.concat(body, block)).otherwise(F.col("text")).alias("text"))
    return docs.select("rel_path", "text"), flagged


def leakage_sweep(s, d):
    needles = s.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("needle"))
    hits = A.containment(_docs(s, d), needles.select("needle").distinct())
    return hits.join(needles, "needle").select(F.col("rel_path").alias("doc_id"), "item_id")


def literal_sweep(s, d):
    named = _docs(s, d).withColumn("rel_path", F.col("rel_path").cast("string"))
    return A.literal_sweep(named, list(TOKENS))


def placeholder_sweep(s, d):
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), T.placeholder(F.col("text"), TOKENS).alias("token")).where("token IS NOT NULL")


def word_counts(s, d):
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), T.wordcount(F.col("text")).alias("words"))


def depth_lint(s, d):
    floor = F.when(F.col("source") == "src0", 400).when(F.col("source").isin("src1", "src2"), 200).otherwise(50)
    return A.depth_lint(_docs(s, d), floor, TOKENS).withColumnRenamed("rel_path", "doc_id")


def repetition_share(s, d):
    """Lines are the blocks of these texts."""
    blocks = F.transform(F.filter(T.lines(F.col("text")), lambda x: ~F.ltrim(x).startswith("|")), lambda x: F.filter(F.split(x, "[ \t\r\n]+"), lambda w: w != ""))
    return A.repetition(_docs(s, d), blocks, 5).withColumnRenamed("rel_path", "doc_id")


def repetition_distribution(s, d):
    shares = repetition_share(s, d).where("total > 0").select((F.col("repeated") / F.col("total")).alias("share"))
    return A.distribution(shares, "share", 0.1)


def slot_refs(s, d):
    """Versions and dotted numbers of the texts that no listed slot explains."""
    refs = A.cross_references(_docs(s, d).withColumn("rel_path", F.col("rel_path").cast("string")), s.createDataFrame([("4.0.1",)], "slot_id string"))
    return refs.select(F.col("rel_path").cast("long").alias("doc_id"), "ref")


def bold_spans(s, d):
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), F.size(T.bold_spans(F.col("text"))).alias("spans")).where("spans > 0")


def content_word_counts(s, d):
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), F.size(T.content_words(F.col("text"))).alias("words"))


def isolated_figures(s, d):
    """Numbers of benchmark-sized needles: each document's order total, searched as an isolated figure."""
    figures = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), 0)).alias("needle")).where("length(needle) BETWEEN 2 AND 15").distinct()
    return A.containment(_docs(s, d), figures, isolated=True).select(F.col("rel_path").alias("doc_id"), "needle")


def content_hash(s, d):
    return A.content_hash(_docs(s, d), ["source"], content="text")


def twin_diff(s, d):
    blind, flagged = _twins(s, d)
    return A.twin_diff(blind, flagged, "## FLAG").withColumnRenamed("rel_path", "doc_id")


def carrier_census(s, d):
    _, flagged = _twins(s, d)
    actual = flagged.where(F.contains("text", F.lit("\n## FLAG\n"))).select("rel_path", F.explode(T.claimed_ids(F.regexp_extract("text", r"(?s)\n## FLAG\n(.*)$", 1))).alias("finding_id"))
    expected = _docs(s, d).where("rel_path % 10 = 0 OR rel_path % 13 = 0").select("rel_path", F.concat(F.lit("F-"), (F.col("rel_path") % 9).cast("string")).alias("finding_id"))
    return A.carrier_census(expected, actual).select(F.col("rel_path").alias("doc_id"), "problem", F.array_join("finding_ids", ",").alias("finding_ids"))


def stale_rows(s, d):
    rows = _docs(s, d).select("rel_path", "lang", "source")
    old = rows.where("rel_path % 9 <> 0").withColumn("lang", F.when(F.col("rel_path") % 8 == 0, None).otherwise(F.col("lang")))
    return A.stale_rows(rows.where("rel_path % 11 <> 0"), old, "rel_path").withColumnRenamed("rel_path", "doc_id")


QUERIES = {f.__name__: f for f in (leakage_sweep, literal_sweep, placeholder_sweep, word_counts, depth_lint, repetition_share, repetition_distribution, slot_refs, bold_spans, content_word_counts, isolated_figures, content_hash, twin_diff, carrier_census, stale_rows)}

_LIST = ", ".join(f"('{t}', {i})" for i, t in enumerate(TOKENS))
_FIRST = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in TOKENS) + " END"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))"
_TWINS = r"""WITH blind AS (SELECT doc_id, text FROM documents), flagged AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || CASE WHEN doc_id % 50 = 0 THEN '!' ELSE '' END || chr(10) || '## FLAG' || chr(10) || '- **F-' || (doc_id % 9) || ' (title)** body' || chr(10) ELSE text END AS text FROM documents WHERE doc_id % 77 <> 0)"""
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)

ORACLE = {
    "leakage_sweep": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "literal_sweep": f"SELECT doc_id::VARCHAR AS rel_path, needle FROM documents, (VALUES {_LIST}) n(needle, k) WHERE contains(lower(text), needle) OR contains(doc_id::VARCHAR, needle)",
    "placeholder_sweep": f"SELECT * FROM (SELECT doc_id, {_FIRST} AS token FROM documents) WHERE token IS NOT NULL",
    "word_counts": f"SELECT doc_id, {_WORDS}::BIGINT AS words FROM documents",
    "depth_lint": f"""SELECT doc_id, words, floor, CASE WHEN token IS NOT NULL THEN 'placeholder' WHEN words < floor THEN 'short' END AS problem FROM
        (SELECT doc_id, {_WORDS}::BIGINT AS words, {_FIRST} AS token, CASE WHEN source = 'src0' THEN 400 WHEN source IN ('src1', 'src2') THEN 200 ELSE 50 END AS floor FROM documents)""",
    "repetition_share": r"""WITH l AS (SELECT doc_id, i, array_to_string(w, ' ') AS k, len(w) AS n FROM (SELECT doc_id, i, list_filter(regexp_split_to_array(line, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM
            (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE NOT starts_with(ltrim(line), '|'))),
        m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS r FROM l)
        SELECT d.doc_id, coalesce(sum(n), 0)::INT AS total, coalesce(sum(CASE WHEN r > 1 AND n >= 5 THEN n END), 0)::INT AS repeated FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1""",
    "slot_refs": r"SELECT DISTINCT doc_id, ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d{1,2}\.\d{1,2}\.\d{1,3})\b', 1)) AS ref FROM documents) WHERE ref <> doc_id::VARCHAR AND ref <> '4.0.1'",
    "bold_spans": r"SELECT doc_id, len(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1))::INT AS spans FROM documents WHERE len(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1)) > 0",
    "content_word_counts": rf"""SELECT doc_id, len(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:[.,][0-9]+)*'), lambda x: replace(x, ',', '')), lambda x: len(x) >= 3 AND x NOT IN ({_STOP})),
        lambda x: CASE WHEN regexp_matches(x, '^[a-z]{{4,}}s$') AND NOT ends_with(x, 'ss') THEN x[:-2] ELSE x END)))::INT AS words FROM documents""",
    "isolated_figures": r"""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS needle FROM documents)
        SELECT DISTINCT doc_id, needle FROM documents JOIN f ON contains(text, needle) WHERE len(needle) BETWEEN 2 AND 15 AND regexp_matches(text, '(^|[^\p{Nd}\p{L}])' || replace(needle, '.', '\.') || '($|[^\p{Nd}\p{L}])')""",
    "content_hash": "SELECT source, sha256(string_agg(x, chr(10) ORDER BY x)) AS content_hash, count(*) AS documents FROM (SELECT source, doc_id::VARCHAR || chr(0) || sha256(text) AS x FROM documents) GROUP BY 1",
    "twin_diff": _TWINS + """SELECT b.doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM blind b LEFT JOIN flagged f USING (doc_id)
        WHERE f.doc_id IS NULL OR (b.text <> f.text AND NOT (starts_with(f.text, b.text || chr(10) || '## FLAG' || chr(10))))""",
    "carrier_census": _TWINS + """, a AS (SELECT doc_id, 'F-' || (doc_id % 9) AS id FROM flagged WHERE doc_id % 5 = 0), e AS (SELECT doc_id, 'F-' || (doc_id % 9) AS id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 13 = 0)
        SELECT doc_id, CASE WHEN a.id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem, coalesce(e.id, a.id) AS finding_ids FROM e FULL JOIN a USING (doc_id) WHERE a.id IS NULL OR e.id IS NULL""",
    "stale_rows": """WITH e AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 11 <> 0), o AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE lang END AS lang, source FROM documents WHERE doc_id % 9 <> 0)
        SELECT doc_id, CASE WHEN o.source IS NULL THEN 'missing' WHEN e.source IS NULL THEN 'extra' ELSE 'changed' END AS state FROM e FULL JOIN o USING (doc_id)
        WHERE o.source IS NULL OR e.source IS NULL OR e.lang IS DISTINCT FROM o.lang OR e.source IS DISTINCT FROM o.source""",
}
ORACLE["repetition_distribution"] = f"WITH s AS ({ORACLE['repetition_share']}) SELECT count(*) AS n, median(repeated / total) AS median, max(repeated / total) AS most, count(*) FILTER (repeated / total > 0.1) AS above FROM s WHERE total > 0"
