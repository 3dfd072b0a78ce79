"""Queries of a key's rules, notes, dates, paragraphs and waves of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import audit as A
from tallyroom.operators import consolidate as K
from tallyroom.operators import tells
from tallyroom.sources import room as R


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def paragraph_repetition(s, d):
    """Each line of a text as a paragraph; those of thirty words that came before."""
    docs = _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return A.repetition(docs, T.paragraphs(F.col("text")))


def _key(s, d):
    """A key of the documents in which every rule is broken by some."""
    n = F.col("doc_id")
    docs = _table(s, d, "documents").select("doc_id")
    source = F.when(n % 10 == 0, _text("/abs/", n)).when(n % 14 == 0, _text("a/../", n)).otherwise(_text("p/", n))
    more = F.when(n % 20 == 0, F.array("source")).when(n % 12 == 0, F.array(_text("c/", n), _text("c/", n))).when(n % 4 == 0, F.array(_text("c/", n))).otherwise(F.array().cast("array<string>"))
    links = F.when(n % 8 == 0, F.array(_text("F-", n + 2))).when(n % 22 == 0, F.array(_text("F-", n))).otherwise(F.array().cast("array<string>"))
    findings = docs.where("doc_id % 2 = 0").withColumn("source", source).select(_text("F-", n).alias("finding_id"), "source", more.alias("corroboration"), (n % 6 != 0).alias("multi_document"), links.alias("cross_links"))
    traps = docs.where("doc_id % 2 = 1").select(_text("D-", n).alias("distractor_id"), "doc_id", F.when(n % 3 == 0, _text("p/", n + 1)).otherwise(_text("q/", n)).alias("location"))
    return findings, traps.select("distractor_id", "location", F.when(n % 5 == 1, F.col("location")).otherwise(_text("r/", n)).alias("resolution"), F.when(n % 7 == 0, _text("F-", n + F.when(n % 3 == 0, 1).otherwise(2))).alias("shape_matches"))


def key_violations(s, d):
    return A.key_violations(*_key(s, d))


def note_pointers(s, d):
    """Notes that cite the next paper but one, among findings of a paper and its neighbours."""
    docs = _table(s, d, "documents").select("doc_id")
    n = F.col("doc_id")
    findings = docs.where("doc_id % 4 = 0").select(_text("F-", n).alias("finding_id"), _text("p", n).alias("source"), F.array(_text("p", n + 1), _text("p", n + 2)).alias("corroboration"))
    traps = docs.where("doc_id % 4 = 3").select(_text("D-", n).alias("distractor_id"), _text("p", n).alias("location"), _text("p", n - 2).alias("resolution"))
    notes = docs.select(_text("p", n).alias("rel_path"), (n % 7).cast("int").alias("line"), _text("s", F.when(n % 3 == 0, n + 1).when(n % 3 == 1, n - 2).otherwise(n + 2)).alias("slot_id"))
    paths = docs.select(_text("s", n).alias("slot_id"), _text("p", n).alias("rel_path"))
    dates = docs.select(_text("p", n).alias("rel_path"), F.when(n % 5 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (n % 3).cast("int"))).alias("date"))
    return tells.pointers(notes, tells.evidence_roles(findings, traps), paths, dates)


def document_dates(s, d):
    """The date of each text behind some lines of its own, with a dated line at a place that depends on it."""
    docs = _table(s, d, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    early = F.when(n % 3 == 0, _text("Received ", n % 28 + 1, " June 2019\n\n")).otherwise("")
    late = _text("\n**Dated: ", n % 31 + 1, F.element_at(F.array(*map(F.lit, ("st", "nd", "rd", "th", ""))), (n % 5 + 1).cast("int")), " February ", n % 30 + 1990, "**\n")
    return docs.select("doc_id", T.document_date(F.concat(early, F.repeat(F.lit("line\n"), (n % 40).cast("int")), late, "text")).cast("string").alias("date"))


def trailing_names(s, d):
    """Parts' names that end a name of the cast, which are made of other parts'."""
    parts = _table(s, d, "part").select("p_partkey", F.initcap("p_name").alias("name"))
    cast = parts.where("p_partkey % 9 = 0").select(_text("Old ", F.col("name"), " Ltd.").alias("name"))
    said = parts.select(_text(F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.substring_index("name", " ", -1)), " ", F.when(F.col("p_partkey") % 3 == 0, "Limited").otherwise("Group")).alias("candidate"), "p_partkey")
    return A.trailing_phrases(said, cast).select("p_partkey", "candidate")


def sides(s, d):
    """Customers' nations without suppliers, and the reverse, by market segment."""
    c = _table(s, d, "customer").where("c_custkey % 5 = 0").select(_text(F.col("c_nationkey"), " ", F.col("c_custkey") % 40).alias("x"))
    return A.both_ways(c, _table(s, d, "supplier").select(_text(F.col("s_nationkey"), " ", F.col("s_suppkey") % 40).alias("x")), "x")


def markdown_reports(s, d):
    """Reports made of whole texts between headings: what is issue, severity and path is found in them."""
    n = F.col("doc_id")
    text = _text("intro high\n# Title\n## Issue ", n, "\n", F.col("text"), "\nA ", F.when(n % 3 == 0, "CRITICAL").when(n % 3 == 1, "medium").otherwise("plain"), " thing in `01/", n, ".md` and `x y.md`, `02/é.pdf`.\n#### Last  one\n#####no\n")
    found = R.markdown_reports(_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), text.alias("text"), "doc_id"))
    return found.select("rel_path", "tool_index", "title", "severity", F.array_join("documents", ";").alias("documents"))


def _wave(s, d):
    o, c = _table(s, d, "orders"), _table(s, d, "customer")
    registry = o.where("o_orderkey % 3 = 0").select(_text(F.substring("o_orderpriority", 1, 1), "P-", F.col("o_orderkey")).alias("finding_id"), F.col("o_orderstatus").alias("title"), F.lit(None).cast("boolean").alias("discoverable_from_blind"), F.lit(None).cast("string").alias("audit_note"))
    key = F.col("c_custkey")
    new = c.select(_text("w", key % 5).alias("label"), _text("w", key % 5, "-NEW-", F.lpad(key.cast("string"), 6, "0")).alias("provisional_id"), F.col("c_mktsegment").alias("workstream"), F.col("c_name").alias("title"))
    ledger = c.where("c_custkey % 10 = 1").select(_text("w", key % 5, "-NEW-", F.lpad(key.cast("string"), 6, "0")).alias("provisional_id"), _text("2P-", key).alias("finding_id"))
    prefixes = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("workstream"), _text(F.length("c_mktsegment") % 5, "P").alias("prefix")).distinct()
    return K.wave(registry, registry.limit(0), new, ledger, prefixes)


def wave_ledger(s, d):
    """New findings under the next numbers of their prefixes, beside those of an earlier run."""
    return _wave(s, d)["ledger"]


def wave_violations(s, d):
    return _wave(s, d)["violations"]


QUERIES = {f.__name__: f for f in (paragraph_repetition, key_violations, note_pointers, document_dates, trailing_names, sides, markdown_reports, wave_ledger, wave_violations)}

_KEY = """WITH d AS (SELECT doc_id FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 20 = 0 THEN [source] WHEN doc_id % 12 = 0 THEN ['c/' || doc_id, 'c/' || doc_id] WHEN doc_id % 4 = 0 THEN ['c/' || doc_id] ELSE []::VARCHAR[] END AS more,
    CASE WHEN doc_id % 8 = 0 THEN 'F-' || (doc_id + 2) WHEN doc_id % 22 = 0 THEN 'F-' || doc_id END AS link, 'F-' || doc_id AS id FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '/abs/' || doc_id WHEN doc_id % 14 = 0 THEN 'a/../' || doc_id ELSE 'p/' || doc_id END AS source FROM d WHERE doc_id % 2 = 0)),
t AS (SELECT 'D-' || doc_id AS id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p/' || (doc_id + 1) ELSE 'q/' || doc_id END AS location, CASE WHEN doc_id % 7 = 0 THEN 'F-' || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END) END AS shape FROM d WHERE doc_id % 2 = 1),
e AS (SELECT id, source AS path FROM f UNION ALL SELECT id, unnest(more) FROM f)
"""
_WAVE = """WITH r AS (SELECT left(o_orderpriority, 1) || 'P-' || o_orderkey AS finding_id FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT 'w' || (c_custkey % 5) AS label, 'w' || (c_custkey % 5) || '-NEW-' || lpad(c_custkey::VARCHAR, 6, '0') AS provisional_id, c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN (length(c_mktsegment) % 5) || 'P' END AS prefix FROM customer),
old AS (SELECT provisional_id, '2P-' || c_custkey AS finding_id FROM n WHERE c_custkey % 10 = 1),
most AS (SELECT string_split(finding_id, '-')[1] AS prefix, max(string_split(finding_id, '-')[2]::BIGINT) AS m FROM (SELECT finding_id FROM r UNION ALL SELECT finding_id FROM old) GROUP BY 1)
"""

ORACLE = {
    "paragraph_repetition": r"""WITH b AS (SELECT doc_id, i, regexp_extract_all(lower(ls[i]), '[a-z0-9]+') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i) WHERE NOT starts_with(ltrim(ls[i], ' '), '|')),
        f AS (SELECT doc_id, i, w, list_position(list_transform(w, lambda t: regexp_matches(t, '[^0-9]')), true) AS k FROM b),
        c AS (SELECT doc_id, i, CASE WHEN k > 0 THEN w[k:] ELSE [] END AS w FROM f),
        o AS (SELECT *, len(w) >= 30 AND row_number() OVER (PARTITION BY doc_id, len(w) >= 30, array_to_string(w, ' ') ORDER BY i) > 1 AS again FROM c)
        SELECT d.doc_id::VARCHAR AS rel_path, coalesce(sum(len(w)), 0)::INT AS total, coalesce(sum(len(w)) FILTER (again), 0)::INT AS repeated FROM documents d LEFT JOIN o USING (doc_id) GROUP BY 1""",
    "key_violations": _KEY + r"""SELECT id AS owner, 'dangling link' AS rule, link AS detail FROM f WHERE link NOT IN (SELECT id FROM f)
        UNION ALL SELECT id, 'link to itself', link FROM f WHERE link = id
        UNION ALL SELECT id, 'multi-document without corroboration, or the reverse', source FROM f WHERE (doc_id % 6 <> 0) <> (len(more) > 0)
        UNION ALL SELECT id, 'bad path', path FROM e WHERE starts_with(path, '/') OR contains(path, '..')
        UNION ALL SELECT id, 'source listed again', source FROM f WHERE list_contains(more, source)
        UNION ALL SELECT id, 'corroboration repeats', source FROM f WHERE len(more) > len(list_distinct(more))
        UNION ALL SELECT id, 'resolution is the location', location FROM t WHERE doc_id % 5 = 1
        UNION ALL SELECT id, 'dangling shape', shape FROM t WHERE shape IS NOT NULL AND shape NOT IN (SELECT id FROM f)
        UNION ALL SELECT id, 'location is evidence', location FROM t WHERE location IN (SELECT path FROM e)""",
    "note_pointers": """WITH d AS (SELECT doc_id AS n, 'p' || doc_id AS p, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 END AS day FROM documents),
        roles AS (SELECT p, 'F-' || n AS owner, true AS root, false AS trap FROM d WHERE n % 4 = 0 UNION SELECT 'p' || (n + 1), 'F-' || n, false, false FROM d WHERE n % 4 = 0 UNION SELECT 'p' || (n + 2), 'F-' || n, false, false FROM d WHERE n % 4 = 0
            UNION SELECT p, 'D-' || n, true, true FROM d WHERE n % 4 = 3 UNION SELECT 'p' || (n - 2), 'D-' || n, false, true FROM d WHERE n % 4 = 3),
        notes AS (SELECT p AS rel_path, (n % 7)::INT AS line, 'p' || CASE n % 3 WHEN 0 THEN n + 1 WHEN 1 THEN n - 2 ELSE n + 2 END AS target, day FROM d)
        SELECT DISTINCT x.rel_path, x.line, x.target, a.owner, CASE WHEN a.trap AND a.root <> b.root THEN CASE WHEN a.root THEN 'forward' ELSE 'backward' END
            WHEN x.day IS NOT NULL AND y.day IS NOT NULL THEN CASE WHEN x.day = y.day THEN 'lateral' WHEN y.day > x.day THEN 'forward' ELSE 'backward' END WHEN b.root THEN 'backward' ELSE 'forward' END AS direction
        FROM notes x JOIN d y ON y.p = x.target JOIN roles a ON a.p = x.rel_path JOIN roles b ON b.p = x.target AND b.owner = a.owner""",
    "document_dates": r"""WITH t AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN 'Received ' || (doc_id % 28 + 1) || ' June 2019' || chr(10) || chr(10) ELSE '' END || repeat('line' || chr(10), (doc_id % 40)::INT) || chr(10) || '**Dated: ' || (doc_id % 31 + 1) || ['st', 'nd', 'rd', 'th', ''][doc_id % 5 + 1] || ' February ' || (doc_id % 30 + 1990) || '**' || chr(10) || text, chr(10)) AS ls FROM documents),
        h AS (SELECT doc_id, list_filter(ls, lambda x: trim(x, ' ') <> '')[1:25] AS ls FROM t),
        f AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: struct_pack(d := regexp_matches(x, '(?i)^[\s*_#]*dated?\b'), m := regexp_extract(x, '\b(\d{1,2})(?:st|nd|rd|th)? (January|February|March|April|May|June|July|August|September|October|November|December) (\d{4})\b'))), lambda y: y.m <> '') AS ms FROM h)
        SELECT doc_id, CAST(try_strptime(regexp_replace(coalesce(list_filter(ms, lambda y: y.d)[1].m, ms[1].m), '(\d)(st|nd|rd|th)', '\1'), '%-d %B %Y')::DATE AS VARCHAR) AS date FROM f""",
    "trailing_names": """WITH p AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])) AS w FROM part),
        tails AS (SELECT DISTINCT array_to_string(list_concat(['Old'], w, ['Limited'])[i:], ' ') AS key FROM p, unnest(range(1, len(w) + 2)) AS u(i) WHERE p_partkey % 9 = 0),
        c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(w, ' ') ELSE w[-1] END || CASE WHEN p_partkey % 3 = 0 THEN ' Limited' ELSE ' Group' END AS candidate FROM p)
        SELECT p_partkey, candidate FROM c WHERE candidate IN (SELECT key FROM tails)""",
    "sides": """WITH c AS (SELECT DISTINCT c_nationkey || ' ' || (c_custkey % 40) AS x FROM customer WHERE c_custkey % 5 = 0), s AS (SELECT DISTINCT s_nationkey || ' ' || (s_suppkey % 40) AS x FROM supplier)
        SELECT x, 'left' AS side FROM c WHERE x NOT IN (SELECT x FROM s) UNION ALL SELECT x, 'right' FROM s WHERE x NOT IN (SELECT x FROM c)""",
    "markdown_reports": r"""WITH t AS (SELECT doc_id::VARCHAR AS rel_path, doc_id, text || chr(10) || 'A ' || CASE doc_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'medium' ELSE 'plain' END || ' thing in ' FROM documents),
        own AS (SELECT doc_id, lower(regexp_extract(text || ' ' || CASE doc_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'medium' ELSE 'plain' END, '(?i)\b(critical|high|medium|low)\b', 1)) AS word FROM documents)
        SELECT doc_id::VARCHAR AS rel_path, 0 AS tool_index, 'Issue ' || doc_id AS title, CASE WHEN word = '' THEN 'medium' ELSE word END AS severity, '01/' || doc_id || '.md;02/é.pdf' AS documents FROM own
        UNION ALL SELECT doc_id::VARCHAR, 1, 'Last  one', 'medium', '' FROM own""",
    "wave_ledger": _WAVE + """SELECT provisional_id, finding_id FROM old UNION ALL
        SELECT provisional_id, prefix || '-' || (coalesce(m, 0) + row_number() OVER (PARTITION BY prefix ORDER BY label, provisional_id)) FROM n LEFT JOIN most USING (prefix) WHERE prefix IS NOT NULL AND c_custkey % 10 <> 1""",
    "wave_violations": _WAVE + "SELECT provisional_id AS finding_id, 'no prefix' AS rule FROM n WHERE prefix IS NULL AND c_custkey % 10 <> 1",
}
