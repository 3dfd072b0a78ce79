"""Queries of answer keys, references, names, carried values and derived trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import answerkey as K
from tallyroom.operators import audit as A
from tallyroom.operators import candidates as N
from tallyroom.operators import derive as D
from tallyroom.operators import houseforms as H
from tallyroom.operators import ranks
from tallyroom.plans.deriving import SEED, _h
from tallyroom.sources import sinks, trees


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _papers(s, d):
    """Documents as files of a tree: source/lang/id.md."""
    return _table(s, d, "documents").select("doc_id", "lang", "source", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel_path"))


def _labels(s, d):
    """Labels of most papers: some are missing, of a type of their own, given twice, empty, or of no paper."""
    p = _papers(s, d)
    kind = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("Odd "), (F.col("doc_id") % 3).cast("string"))).when(F.col("doc_id") % 103 == 0, " ").otherwise(F.concat(F.lit("Type "), "lang"))
    most = p.where("doc_id % 97 <> 0").select(F.col("rel_path").alias("path"), kind.alias("document_type"), "doc_id")
    return most.select("path", "document_type").union(most.where("doc_id % 89 = 0").select("path", "document_type")).union(p.where("doc_id % 101 = 0").select(F.concat(F.lit("gone/"), "rel_path"), F.lit("Type en")))


def _sections(s, d):
    sources = _table(s, d, "documents").select("source").distinct()
    flat = sources.where("source <> 'src5'").select(F.col("source").alias("dir_name"), F.when(F.col("source") != "src3", F.concat(F.lit("team "), "source")).alias("classifier_workstream"))
    return flat.union(sources.where("source NOT IN ('src5', 'src2')").select(F.concat("source", F.lit("/de")), F.concat(F.lit("german "), "source")))


def _vocabulary(s, d):
    return _table(s, d, "documents").select(F.concat(F.lit("Type "), "lang").alias("name")).distinct()


def _judged(s, d):
    return K.judged(_papers(s, d), _labels(s, d), _sections(s, d), _vocabulary(s, d))


def answer_key(s, d):
    said = K.records(_judged(s, d))
    return said.select("source_path", "document_type", "primary_workstream", K.record_line(F.col("source_path"), F.col("document_type"), F.col("primary_workstream")).alias("line"))


def answer_key_breaches(s, d):
    return K.breaches(_judged(s, d))


def label_drift(s, d):
    return K.label_drift(_labels(s, d).where("trim(document_type) <> ''"), _vocabulary(s, d))


def longest_section(s, d):
    found = K.sections_of(_papers(s, d).select("rel_path"), _sections(s, d))
    return found.select("rel_path", "section", "classifier_workstream")


def evidence_outside_sections(s, d):
    p = _papers(s, d)
    findings = p.where("doc_id % 5 = 0").select(F.concat(F.when(F.col("doc_id") % 35 == 0, F.lit("old-")).otherwise(""), "rel_path").alias("source"), F.array(F.concat("lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"))).alias("corroboration"))
    traps = p.where("doc_id % 13 = 0").select(F.col("rel_path").alias("location"), F.concat("source", F.lit("x/"), "lang").alias("resolution"))
    return K.outside_sections(findings, traps, _sections(s, d))


def clause_numbers(s, d):
    """Numbers put behind whole texts in all the ways that decide whether they are references."""
    n = F.col("doc_id")
    number = lambda a, b, c: F.concat_ws(".", *((n % m + 1).cast("string") for m in (a, b, c)))
    tail = F.concat(F.lit("\nsee "), number(9, 5, 20), F.lit(", clauses "), number(7, 3, 11), F.lit(" and "), number(4, 9, 8), F.lit("; then\n**"), number(6, 6, 6), F.lit("** Rent\n- "), number(30, 2, 5), F.lit(" or schedule\t"), number(3, 3, 3))
    docs = _papers(s, d).select(F.concat(F.lit("p/"), number(5, 4, 3), F.lit("_"), "doc_id", F.lit(".md")).alias("rel_path"), F.concat("text", tail).alias("text"))
    slots = s.range(1, 6).select(F.concat(F.lit("1."), F.col("id").cast("string"), F.lit(".1")).alias("slot_id"))
    return A.checked_references(docs, slots, s.range(1, 9).select(F.col("id").cast("int").alias("number")), ["2.2.2"])


def carried_headings(s, d):
    """Each line of each text with the last line before it that has a number, or itself."""
    lines = _table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("heading", F.when(F.col("line").rlike("[0-9]"), F.sha2("line", 256)))
    return ranks.carried(lines, "heading", "pos", by=("doc_id",)).select("doc_id", "pos", F.col("carried").alias("heading"))


def event_ranks(s, d):
    """The place of each event among all and among those of its type, by value."""
    e = _table(s, d, "events").select("event_id", "event_type", "value")
    return ranks.ranked(ranks.ranked(e, "value", "event_id"), "value", "event_id", by=("event_type",), name="of_type").select("event_id", "rank", "of_type")


def moved_rows(s, d):
    """Papers on disk in another order: some pairs are exchanged, some are not there."""
    papers = _papers(s, d)
    n = F.col("doc_id")
    line = n + F.when(n % 50 == 10, 1).when(n % 50 == 11, -1).otherwise(0)
    want = papers.select(F.lpad(n.cast("string"), 12, "0").alias("source_path"))
    have = papers.where("doc_id % 17 <> 3").select(F.lpad(n.cast("string"), 12, "0").alias("source_path"), line.alias("line"))
    return A.moved_rows(want, have, "source_path", "line")


def name_candidates(s, d):
    """A fact sheet for each nation: prose, its suppliers as cast, its customers as declared names, then a table below another heading."""
    sup, cus = _table(s, d, "supplier"), _table(s, d, "customer")
    kinds = F.element_at(F.array(*map(F.lit, ("entity", "Brand", "site", "person", "", "thing", "domain"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    person = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Mark "), (F.col("c_custkey") % 60).cast("string")))
    rows = sup.select(F.col("s_nationkey").alias("n"), F.lit(1).alias("p"), F.concat(F.lit("| "), "s_name", F.lit(" | chair |")).alias("x")).union(cus.select("c_nationkey", F.lit(2), F.concat(F.lit("| "), person, F.lit(" | "), kinds, F.lit(" |"))))
    both = rows.groupBy("n").agg(F.array_sort(F.collect_set(F.when(F.col("p") == 1, F.col("x")))).alias("cast"), F.array_sort(F.collect_set(F.when(F.col("p") == 2, F.col("x")))).alias("declared"))
    name = F.concat(F.lit("Nation"), F.col("n").cast("string"))
    text = F.concat(F.lit("It is about "), name, F.lit(" Holdings Ltd and of The "), name, F.lit(" Works GmbH,\n## Cast\n| Name | Role |\n|---|---|\n"), F.array_join("cast", "\n"), F.lit("\n## Invented names\n| Name | Kind |\n|---|---|\n"), F.array_join("declared", "\n"), F.lit("\n### Later\n| No | brand |\n"))
    return N.candidates(both.select(F.col("n").cast("string").alias("rel_path"), text.alias("text")))


def archetype_floors(s, d):
    patterns = s.createDataFrame([("widget", "tool", 300), ("small widget", "part", 200), ("bolt", "metal", 100), ("t", "any", 50), ("arge", "big", 700), ("idge", "small", 10)], "pattern string, archetype string, floor int")
    parts = _table(s, d, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("_"), "p_name", F.lit(".md")).alias("rel_path"), F.when(F.col("p_size") > 20, "A").otherwise("F").alias("tier"))
    return A.floors(parts, A.archetypes(parts, patterns, "other"), patterns.select("archetype", "floor"), 350)


def entity_names(s, d):
    """Corporate names made of parts' names, in the ways that decide where a name begins and ends."""
    said = F.concat(F.lit("of "), F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, " Limited Company.").otherwise(" Ltd, "), F.lit("the\n\nBig "), F.initcap("p_name"), F.lit(" Four Five\nGmbH. The Sum PLC"))
    return _table(s, d, "part").select("p_partkey", F.array_join(T.entity_tokens(said), "; ").alias("names"))


def masked_names(s, d):
    """Each text with a number in it, and what is left of a part's name when some names are masked."""
    said = F.concat("p_name", F.lit(" (the LARGE\nBolt's) "), F.lit("boltx small  widget."), F.col("p_partkey").cast("string"))
    return _table(s, d, "part").select("p_partkey", T.mask_names(said, ["large bolt", "Small Widget", "widget"]).alias("left"))


def flagged_tree(s, d):
    p = _papers(s, d).select("rel_path", "text", "doc_id", "lang")
    carried = p.where("doc_id % 6 = 0").select("rel_path", F.concat(F.lit("F-"), F.col("doc_id").cast("string")).alias("finding_id"), F.col("lang").alias("title"), F.lit("So it is.").alias("substance"))
    both = carried.union(carried.where("title = 'en'").select("rel_path", F.lit("A-1"), F.lit("all"), F.lit("It too.")))
    return sinks.flagged_tree(p.select("rel_path", "text"), both, "## FLAG").select("rel_path", F.sha2("text", 256).alias("text_sha256"))


def carrier_tally(s, d):
    p = _papers(s, d)
    files = p.select(F.when(F.col("doc_id") % 4 == 0, F.replace("rel_path", F.lit(".md"), F.lit(".csv"))).otherwise(F.col("rel_path")).alias("rel_path"), "doc_id")
    return trees.carrier_tally(files, files.where("doc_id % 6 = 0"))


def _twin(s, d):
    """Names of papers, no two alike, damaged (their texts do not matter here); a key of their languages."""
    p = _papers(s, d).select(F.concat("source", F.lit("/"), F.md5(F.col("doc_id").cast("string")), F.lit("-report.md")).alias("rel_path"), "text", "lang", "source")
    key = p.select(F.col("rel_path").alias("source_path"), F.col("lang").alias("document_type"), F.col("source").alias("primary_workstream"))
    sources = [f"src{i}" for i in range(20)]
    return D.damaged(p.select("rel_path", F.lit("").alias("text")), SEED, "heavy", sources), key


def corrupted_key(s, d):
    """Paths of a damaged tree with the records of the documents that they come from."""
    twin, key = _twin(s, d)
    said = twin.join(key.withColumnRenamed("source_path", "rel_path"), "rel_path")
    return said.select("new_path", "document_type", "primary_workstream", K.record_line(F.col("new_path"), F.col("document_type"), F.col("primary_workstream")).alias("line"))


def corruption_report(s, d):
    """Counts of what was done; whole texts, cut where they have thirty lines."""
    p = _papers(s, d).select(F.concat("source", F.lit("/"), F.md5(F.col("doc_id").cast("string")), F.lit("-report.md")).alias("rel_path"), "text", "lang")
    key = p.select(F.col("rel_path").alias("source_path"), F.col("lang").alias("document_type"), F.col("lang").alias("primary_workstream"))
    return trees.corruption_report(trees.corrupted(p.select("rel_path", "text"), key, SEED, "heavy", [f"src{i}" for i in range(20)]))


def house_form_deviations(s, d):
    """Texts as forms, a paragraph a line; of the derived ones some are gone, some are new."""
    p = _papers(s, d).select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id", F.split("text", "\n").alias("ls"))
    lines = F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x, F.when(i % 5 == 4, F.lit(" [BLANK]")).otherwise("")))
    left = F.filter(F.transform(lines, lambda x, i: F.when(((i + 1) * (i + 1) + F.col("doc_id")) % 11 != 0, x)), lambda x: x.isNotNull())
    texts = p.select("rel_path", F.array_join(lines, "\n\n").alias("house_text"), F.concat(F.array_join(left, "\n\n"), F.when(F.col("doc_id") % 3 == 0, "\n\nIt is new.").otherwise("")).alias("text"))
    return H.deviations(texts)


QUERIES = {f.__name__: f for f in (answer_key, answer_key_breaches, label_drift, longest_section, evidence_outside_sections, clause_numbers, carried_headings, event_ranks, moved_rows, name_candidates, archetype_floors, entity_names, masked_names, flagged_tree, carrier_tally, corrupted_key, corruption_report, house_form_deviations)}

_PAPERS = "papers AS (SELECT doc_id, lang, source, text, source || '/' || lang || '/' || doc_id || '.md' AS rel_path FROM documents)"
_KEY = f"""WITH {_PAPERS},
most AS (SELECT doc_id, rel_path AS path, CASE WHEN doc_id % 11 = 0 THEN 'Odd ' || (doc_id % 3) WHEN doc_id % 103 = 0 THEN ' ' ELSE 'Type ' || lang END AS document_type FROM papers WHERE doc_id % 97 <> 0),
given AS (SELECT path, document_type FROM most UNION ALL SELECT path, document_type FROM most WHERE doc_id % 89 = 0 UNION ALL SELECT 'gone/' || rel_path, 'Type en' FROM papers WHERE doc_id % 101 = 0),
vocabulary AS (SELECT DISTINCT 'Type ' || lang AS name FROM documents),
sources AS (SELECT DISTINCT source FROM documents),
sections AS (SELECT source AS dir_name, CASE WHEN source <> 'src3' THEN 'team ' || source END AS classifier_workstream FROM sources WHERE source <> 'src5'
    UNION ALL SELECT source || '/de', 'german ' || source FROM sources WHERE source NOT IN ('src5', 'src2')),
longest AS (SELECT rel_path, arg_max(dir_name, length(dir_name)) AS section, arg_max(coalesce(classifier_workstream, '-'), length(dir_name)) AS workstream FROM papers JOIN sections ON starts_with(rel_path, dir_name || '/') GROUP BY 1),
said AS (SELECT path, count(*) AS n, min(document_type) AS document_type FROM given GROUP BY 1),
breaches AS (
    SELECT 'incomplete label' AS rule, path AS detail FROM given WHERE trim(document_type) = ''
    UNION ALL SELECT 'labelled twice', path FROM said WHERE n > 1
    UNION ALL SELECT 'outside the vocabulary', document_type FROM said WHERE trim(document_type) <> '' AND document_type NOT IN (SELECT name FROM vocabulary)
    UNION ALL SELECT 'without a label', rel_path FROM papers WHERE rel_path NOT IN (SELECT path FROM given)
    UNION ALL SELECT 'without a document', path FROM given WHERE path NOT IN (SELECT rel_path FROM papers)
    UNION ALL SELECT 'unknown section', source FROM papers ANTI JOIN longest USING (rel_path)
    UNION ALL SELECT 'section without a workstream', section FROM longest WHERE workstream = '-'),
clean AS (SELECT rel_path AS source_path, document_type, workstream AS primary_workstream FROM papers JOIN said ON path = rel_path JOIN longest USING (rel_path)
    WHERE n = 1 AND document_type IN (SELECT name FROM vocabulary) AND workstream <> '-')
"""


def _shown(by: str, detail: str, source: str) -> str:
    return f"""SELECT {by}, count(*) AS n, string_agg(detail, ', ' ORDER BY detail) FILTER (k <= 10) || CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ' more)' ELSE '' END AS named
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY detail) AS k FROM (SELECT DISTINCT {by}, {detail} AS detail FROM {source})) GROUP BY 1"""


_LINE = """'{{"source_path": "' || {0} || '", "document_type": "' || document_type || '", "primary_workstream": "' || primary_workstream || '", "secondary_workstreams": []}}'"""
_TAIL = "chr(10) || 'see ' || {0} || ', clauses ' || {1} || ' and ' || {2} || '; then' || chr(10) || '**' || {3} || '** Rent' || chr(10) || '- ' || {4} || ' or schedule' || chr(9) || {5}"
_NUMBER = lambda a, b, c: f"(doc_id % {a} + 1) || '.' || (doc_id % {b} + 1) || '.' || (doc_id % {c} + 1)"
_REF = r"\b\d{1,2}\.\d{1,2}\.\d{1,3}\b"
_CLAUSE = r"(?i)(?:\A|[^\pL\pN_])(?:" + "|".join(T.CLAUSE_WORDS) + r")s?\s+(?:\d[\d.]*(?:\([a-z0-9]+\))*\s*(?:,\s*(?:and/or|and|or|to)?|and/or|and|or|to|[–-])\s*)*\z"
_OPENS = r"(?:\A|\n)[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*?|__?)?\z"
_TREE = f"""papers AS (SELECT doc_id::VARCHAR AS doc_id, lang, source, text, source || '/' || md5(doc_id::VARCHAR) || '-report.md' AS rel_path, md5(doc_id::VARCHAR) || '-report' AS stem FROM documents),
hits AS (SELECT *, {_h('rel_path', "'rename'")} % 10000 < {D.PROFILES['heavy']['rename']} AS renamed, {_h('rel_path', "'misfile'")} % 10000 < {D.PROFILES['heavy']['misfile']} AS misfiled,
    {_h('rel_path', "'noise'")} % 10000 < {D.PROFILES['heavy']['noise']} AS noised, {_h('rel_path', "'truncate'")} % 10000 < {D.PROFILES['heavy']['truncate']} AS cut FROM papers)"""
_TAGS = "[" + ", ".join(f"'{t}'" for t in T.RENAME_TAGS) + "]"

ORACLE = {
    "house_form_deviations": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, i, len(ls) AS n, (i * i + doc_id) % 11 = 0 AS gone, i % 5 = 0 OR regexp_matches(ls[i], '\[[A-Z][^\[\]\n]{0,80}\]') AS blank FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
        t AS (SELECT doc_id, count(*) FILTER (gone AND NOT blank) AS lost, bool_or(gone AND i = n) AS tail FROM p GROUP BY 1)
        SELECT doc_id::VARCHAR AS rel_path, (lost + CASE WHEN doc_id % 3 = 0 AND NOT tail THEN 1 ELSE 0 END)::INT AS n FROM t""",
    "answer_key": _KEY + f"SELECT *, {_LINE.format('source_path')} AS line FROM clean",
    "answer_key_breaches": _KEY + _shown("rule", "detail", "breaches"),
    "label_drift": _KEY + _shown("document_type", "path", "(SELECT * FROM given WHERE trim(document_type) <> '' AND document_type NOT IN (SELECT name FROM vocabulary))"),
    "longest_section": _KEY + "SELECT rel_path, section, nullif(workstream, '-') AS classifier_workstream FROM papers LEFT JOIN longest USING (rel_path)",
    "evidence_outside_sections": _KEY + """, paths AS (SELECT CASE WHEN doc_id % 35 = 0 THEN 'old-' ELSE '' END || rel_path AS rel_path FROM papers WHERE doc_id % 5 = 0
        UNION SELECT lang || '/' || (doc_id % 7) FROM papers WHERE doc_id % 5 = 0 UNION SELECT rel_path FROM papers WHERE doc_id % 13 = 0 UNION SELECT source || 'x/' || lang FROM papers WHERE doc_id % 13 = 0)
        SELECT rel_path FROM paths WHERE string_split(rel_path, '/')[1] NOT IN (SELECT dir_name FROM sections)""",
    "clause_numbers": f"""WITH d AS (SELECT 'p/' || {_NUMBER(5, 4, 3)} || '_' || doc_id || '.md' AS rel_path, {_NUMBER(5, 4, 3)} AS own,
            text || {_TAIL.format(_NUMBER(9, 5, 20), _NUMBER(7, 3, 11), _NUMBER(4, 9, 8), _NUMBER(6, 6, 6), _NUMBER(30, 2, 5), _NUMBER(3, 3, 3))} AS t FROM documents),
        c AS (SELECT *, string_split_regex(t, '{_REF}') AS p, regexp_extract_all(t, '{_REF}') AS r FROM d),
        x AS (SELECT rel_path, own, r[i] AS ref, right(array_to_string(list_transform(range(greatest(1, i - 30), i), lambda j: right(p[j], 120) || r[j]), '') || right(p[i], 120), 120) AS l FROM c, unnest(range(1, len(r) + 1)) AS u(i)),
        y AS (SELECT DISTINCT rel_path, own, ref, string_split(ref, '.')[1]::INT AS n FROM x WHERE NOT regexp_matches(l, '{_OPENS}') AND NOT regexp_matches(l, '{_CLAUSE}'))
        SELECT rel_path, ref, CASE WHEN n NOT BETWEEN 1 AND 8 THEN 'out of range' ELSE 'dangling' END AS problem FROM y
        WHERE n NOT BETWEEN 1 AND 8 OR NOT (ref = own OR ref = '2.2.2' OR ref IN (SELECT '1.' || k || '.1' FROM unnest(range(1, 6)) AS u(k)))""",
    "carried_headings": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM s, unnest(range(1, len(ls) + 1)) AS u(i))
        SELECT doc_id, pos::INT AS pos, last_value(CASE WHEN regexp_matches(line, '[0-9]') THEN sha256(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM l""",
    "event_ranks": "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rank, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS of_type FROM events",
    "moved_rows": """WITH h AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS source_path, doc_id + CASE WHEN doc_id % 50 = 10 THEN 1 WHEN doc_id % 50 = 11 THEN -1 ELSE 0 END AS line FROM documents WHERE doc_id % 17 <> 3),
        r AS (SELECT source_path, line, row_number() OVER (ORDER BY source_path) AS want FROM h)
        SELECT source_path FROM (SELECT source_path, want, coalesce(lag(want) OVER (ORDER BY line) + 1, 1) AS due FROM r) WHERE want <> due""",
    "name_candidates": """WITH cast_ AS (SELECT DISTINCT s_nationkey AS n, s_name AS name FROM supplier),
        declared AS (SELECT DISTINCT c_nationkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') ELSE 'Mark ' || (c_custkey % 60) END AS name, ['entity', 'brand', 'site', 'person', '', 'thing', 'domain'][c_custkey % 7 + 1] AS kind FROM customer),
        nations AS (SELECT n FROM cast_ UNION SELECT n FROM declared),
        every AS (SELECT n, name, 'person' AS kind, 1 AS by_ FROM cast_ UNION ALL SELECT n, name, kind, 3 FROM declared UNION ALL SELECT n, 'Nation' || n || ' Holdings Ltd', 'entity', 2 FROM nations UNION ALL SELECT n, 'Nation' || n || ' Works GmbH', 'entity', 2 FROM nations),
        told AS (SELECT n, name, max(struct_pack(b := by_, k := kind)).k AS kind, min(kind) FILTER (by_ = 3) AS low, max(kind) FILTER (by_ = 3) AS high, bool_or(by_ = 1) AS in_cast, coalesce(bool_or(kind = 'thing' OR kind = '') FILTER (by_ = 3), false) AS unknown FROM every GROUP BY 1, 2)
        SELECT n::VARCHAR AS rel_path, name, kind, CASE WHEN low = '' THEN 'no kind' WHEN unknown THEN 'unknown kind' WHEN low <> high THEN 'two kinds' WHEN in_cast AND high <> 'person' THEN 'in the cast, but not declared a person' END AS fault FROM told""",
    "archetype_floors": """WITH pats(pattern, archetype, floor) AS (VALUES ('widget', 'tool', 300), ('small widget', 'part', 200), ('bolt', 'metal', 100), ('t', 'any', 50), ('arge', 'big', 700), ('idge', 'small', 10)),
        p AS (SELECT p_brand || '/' || p_partkey || '_' || p_name || '.md' AS rel_path, lower(p_partkey || '_' || p_name || '.md') AS name, p_size > 20 AS a FROM part),
        b AS (SELECT rel_path, arg_max(floor, struct_pack(l := length(pattern), f := floor)) AS floor FROM p JOIN pats ON contains(name, pattern) GROUP BY 1)
        SELECT rel_path, (CASE WHEN a THEN coalesce(floor, 350) ELSE 350 END)::INT AS floor FROM p LEFT JOIN b USING (rel_path)""",
    "entity_names": """WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS t FROM part),
        e AS (SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 3 <> 0 THEN t || ' Ltd' END, array_to_string(string_split('Big ' || t || ' Four Five', ' ')[-4:], ' ') || ' GmbH', 'Sum PLC'], lambda x: x IS NOT NULL)) AS name FROM n)
        SELECT p_partkey, string_agg(name, '; ' ORDER BY name) AS names FROM (SELECT DISTINCT p_partkey, name FROM e) GROUP BY 1""",
    "masked_names": """SELECT p_partkey, CASE WHEN p_name = 'large bolt' OR p_name = 'small widget' THEN ' ' WHEN ends_with(p_name, ' widget') THEN replace(p_name, 'widget', ' ') ELSE p_name END || ' (the  ''s) boltx  .' || p_partkey AS left FROM part""",
    "flagged_tree": f"""WITH {_PAPERS} SELECT rel_path, sha256(text || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '## FLAG' || chr(10) || CASE WHEN lang = 'en' THEN '- **A-1 (all)** It too.' || chr(10) ELSE '' END || '- **F-' || doc_id || ' (' || lang || ')** So it is.' || chr(10) ELSE '' END) AS text_sha256 FROM papers""",
    "carrier_tally": "SELECT count(*) AS written, count(*) FILTER (doc_id % 6 = 0 AND doc_id % 4 <> 0) AS carriers, count(*) FILTER (NOT (doc_id % 6 = 0 AND doc_id % 4 <> 0)) AS identical FROM documents",
    "corrupted_key": f"""WITH {_TREE}, named AS (SELECT *, CASE WHEN NOT renamed THEN stem ELSE CASE {_h('rel_path', "'rename-variant'")} % 4 WHEN 0 THEN stem || {_TAGS}[({_h('rel_path', "'rename-tag'")} % 8 + 1)::INT] WHEN 1 THEN upper(stem)
            WHEN 2 THEN replace(stem, '-', ' ') ELSE left(stem, k) || substr(stem, k + 2) END END AS final,
            CASE WHEN misfiled THEN list_filter([{', '.join(f"'src{i}'" for i in range(20))}], lambda x: x <> source)[({_h('rel_path', "'misfile-dir'")} % 19 + 1)::INT] ELSE source END AS folder
            FROM (SELECT *, ({_h('rel_path', "'rename-typo'")} % (len(stem) - 2)::UBIGINT + 1)::INT AS k FROM hits)),
        keyed AS (SELECT folder || '/' || final || '.md' AS new_path, lang AS document_type, source AS primary_workstream FROM named)
        SELECT *, {_LINE.format('new_path')} AS line FROM keyed""",
    "corruption_report": f"""WITH {_TREE}, l AS (SELECT *, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n FROM hits)
        SELECT count(*) AS documents, count(*) FILTER (renamed) AS renamed, count(*) FILTER (misfiled) AS misfiled, count(*) FILTER (noised) AS noised, count(*) FILTER (cut AND n >= 30) AS truncated FROM l""",
}
