"""Queries of deterministic derivatives, orders and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import consolidate as K
from tallyroom.operators import derive as D
from tallyroom.operators import order as O
from tallyroom.operators import tells

SEED = 7


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "text", "lang", "source")


def hash_subset(s, d):
    docs = _docs(s, d)
    picked = D.hash_subset(docs, docs.where("lang = 'es' AND rel_path % 10 = 0"), 120)
    return picked.select(F.col("rel_path").cast("long").alias("doc_id"), "role")


def hash_sample(s, d):
    return D.hash_sample(_docs(s, d), 25, "7").select(F.col("rel_path").cast("long").alias("doc_id"))


def corrupt_decisions(s, d):
    return D.decisions(_docs(s, d), SEED, "heavy").withColumnRenamed("rel_path", "doc_id")


def _stem():
    return F.concat_ws("_", "source", F.concat("lang", F.lit("-report")))


def rename_variants(s, d):
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), T.renamed(SEED, F.col("rel_path"), _stem()).alias("stem"))


def misfile_targets(s, d):
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), D.misfiled(SEED, F.col("rel_path"), F.col("lang"), ["de", "en", "es", "fr"]).alias("target"))


def collision_suffix(s, d):
    named = _docs(s, d).select("rel_path", F.col("source").alias("folder"), F.lit(".md").alias("suffix"), F.col("lang").alias("stem"))
    return D.unique_names(named).select(F.col("rel_path").alias("doc_id"), "folder", "final")


def truncate_lines(s, d):
    short = T.truncated(SEED, F.col("rel_path"), F.col("text"), 4)  # most texts have four lines, few have thirty
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), F.sha2(short, 256).alias("digest"), (short != F.col("text")).alias("cut"))


def noise_hashed(s, d):
    noisy = D.noise_hashed(SEED, F.col("rel_path"), F.col("text"), 2000)
    return _docs(s, d).select(F.col("rel_path").alias("doc_id"), F.sha2(noisy, 256).alias("noisy_sha256"))


def _sections(s, d):
    return _table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("number"), F.col("n_name").alias("dir_name"), (F.col("n_regionkey") + 1).cast("long").alias("weight"), F.array(*(F.lit(x) for x in ("one", "two", "three"))).alias("subsections"))


def slot_allocation(s, d):
    return O.apportioned(_sections(s, d), 200).select("number", "count")


def slot_manifest(s, d):
    return O.slot_manifest(O.apportioned(_sections(s, d), 200)).select("slot_id", "tier", "rel_path")


def authoring_order(s, d):
    slots = _table(s, d, "part").select(F.col("p_partkey").alias("rel_path"), F.col("p_partkey").alias("position"), F.when(F.col("p_size") > 25, "A").otherwise("F").alias("tier"))
    return O.authoring_order(slots, slots.where("rel_path % 7 = 0"), slots.where("rel_path % 31 = 0")).select("rel_path", "rank")


def severity_targets(s, d):
    sizes = _table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total")).select("total")
    return O.severity_targets(sizes.union(s.range(4, 5).select(F.col("id").alias("total"))).distinct())


def id_allocation(s, d):
    c = _table(s, d, "customer")
    found = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") % 5).cast("string").alias("label"), F.format_string("NEW-%06d", "c_custkey").alias("provisional_id"), F.substring("c_mktsegment", 1, 3).alias("prefix"))
    old = c.where("c_custkey % 2 = 1").select(F.concat(F.substring("c_mktsegment", 1, 3), F.lit("-"), F.col("c_custkey").cast("string")).alias("finding_id"))
    return O.allocated_ids(found, old)


def budget_batches(s, d):
    return O.budget_batches(_table(s, d, "part"), ["p_brand"], "p_partkey", "p_partkey", "p_size", 100)


def house_families(s, d):
    slots = _table(s, d, "part").select(F.col("p_brand").alias("section"), F.col("p_type").alias("subsection"), F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("rel_path"))
    return O.house_families(slots, 3).where("house IS NOT NULL").select("rel_path", "house")


def note_asymmetry(s, d):
    docs = _docs(s, d).select(F.col("source").alias("section"), (F.col("lang") == "en").alias("is_evidence"), F.contains("text", F.lit("the")).alias("has_note"))
    return tells.note_asymmetry(docs, 3, 0.5)


def section_habits(s, d):
    e = _table(s, d, "events").select(F.col("event_type").alias("section"), F.col("user_id").alias("rel_path"), (F.col("event_id") % 20).alias("target"))
    return tells.section_habits(e, e.select("section", "rel_path"), 0.3, 3)


def turn_pointer_direction(s, d):
    turns = _table(s, d, "conversations").select("conv_id", "turn", "role")
    a, b = turns.select("conv_id", F.col("turn").alias("a"), F.col("role").alias("a_role")), turns.select("conv_id", F.col("turn").alias("b"), F.col("role").alias("b_role"))
    both = a.join(b, "conv_id").where("a <> b")
    said = tells.direction(F.col("a_role") == "user", F.col("b_role") == "user", F.col("conv_id") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, F.floor(F.col("a") / 2)), F.floor(F.col("b") / 2))
    return both.select("conv_id", "a", "b", said.alias("direction"))


def wave_consolidate(s, d):
    o = _table(s, d, "orders")
    registry = o.select(F.concat(F.lit("F-"), F.col("o_orderkey").cast("string")).alias("finding_id"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 4 == 0, False).alias("discoverable_from_blind"), F.lit(None).cast("string").alias("audit_note"))
    said = o.where("o_orderkey % 6 = 0").select(F.concat(F.lit("F-"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 36 == 0, 10000000).otherwise(0)).cast("string")).alias("finding_id"), F.when(F.col("o_orderkey") % 12 == 0, F.lit("X")).alias("title"), F.lit(True).alias("discoverable_from_blind"), F.col("o_orderpriority").alias("audit_note"))
    none = s.createDataFrame([], "label string, provisional_id string, workstream string, title string")
    out = K.wave(registry, said, none, s.createDataFrame([], "provisional_id string, finding_id string"), s.createDataFrame([], "workstream string, prefix string"))
    return out["registry"].select("finding_id", "title", "discoverable_from_blind", "audit_note")


def label_conflicts(s, d):
    docs = _docs(s, d).select(F.concat("source", F.lit("/"), (F.col("rel_path").cast("long") % 40).cast("string")).alias("path"), F.col("lang").alias("document_type"))
    _, bad = K.labels(docs.where("path < 'src3'"), docs.where("path >= 'src3'"))
    return bad.select("path", F.array_join("types", ",").alias("types"))


QUERIES = {f.__name__: f for f in (hash_subset, hash_sample, corrupt_decisions, rename_variants, misfile_targets, collision_suffix, truncate_lines, noise_hashed, slot_allocation, slot_manifest, authoring_order, severity_targets, id_allocation, budget_batches, house_families, note_asymmetry, section_habits, turn_pointer_direction, wave_consolidate, label_conflicts)}


def _h(*parts: str) -> str:
    joined = " || '|' || ".join([f"'{SEED}'", *parts])
    return f"('0x' || substr(sha256({joined}), 1, 16))::UBIGINT"


_P = "doc_id::VARCHAR"
_TAGS = "[" + ", ".join(f"'{t}'" for t in T.RENAME_TAGS) + "]"
_ALLOC = """SELECT number, dir_name, 1 + whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, number) <= short THEN 1 ELSE 0 END AS count FROM
    (SELECT number, dir_name, whole, rest, 200 - n - sum(whole) OVER () AS short FROM (SELECT n_nationkey AS number, n_name AS dir_name, count(*) OVER () AS n, ((200 - count(*) OVER ()) * (n_regionkey + 1)) // sum(n_regionkey + 1) OVER () AS whole, ((200 - count(*) OVER ()) * (n_regionkey + 1)) % sum(n_regionkey + 1) OVER () AS rest FROM nation))"""
_SWAP = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in D.CONFUSIONS.items()) + "}"

ORACLE = {
    "hash_subset": f"""WITH e AS (SELECT doc_id FROM documents WHERE lang = 'es' AND doc_id % 10 = 0)
        SELECT doc_id, 'evidence' AS role FROM e UNION ALL SELECT doc_id, 'filler' FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256({_P})) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)) WHERE r <= greatest(0, 120 - (SELECT count(*) FROM e))""",
    "hash_sample": f"SELECT doc_id FROM documents WHERE ends_with({_P}, '7') ORDER BY sha256({_P}) LIMIT 25",
    "corrupt_decisions": f"SELECT {_P} AS doc_id, " + ", ".join(f"({_h(_P, chr(39) + k + chr(39))} % 10000 < {D.PROFILES['heavy'][k]}) AS {k if k != 'truncate' else chr(34) + k + chr(34)}" for k in ("rename", "misfile", "noise", "truncate")) + " FROM documents",
    "rename_variants": f"""WITH s AS (SELECT {_P} AS doc_id, source || '_' || lang || '-report' AS stem FROM documents)
        SELECT doc_id, CASE {_h('doc_id', "'rename-variant'")} % 4 WHEN 0 THEN stem || {_TAGS}[({_h('doc_id', "'rename-tag'")} % 8 + 1)::INT] WHEN 1 THEN upper(stem) WHEN 2 THEN replace(stem, '-', ' ')
        ELSE left(stem, k) || substr(stem, k + 2) END AS stem FROM (SELECT *, ({_h('doc_id', "'rename-typo'")} % (len(stem) - 2)::UBIGINT + 1)::INT AS k FROM s)""",
    "misfile_targets": f"SELECT {_P} AS doc_id, list_filter(['de', 'en', 'es', 'fr'], lambda x: x <> lang)[({_h(_P, chr(39) + 'misfile-dir' + chr(39))} % 3 + 1)::INT] AS target FROM documents",
    "collision_suffix": f"SELECT {_P} AS doc_id, source AS folder, lang || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END AS final FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {_P}) AS r FROM documents)",
    "truncate_lines": f"""WITH l AS (SELECT {_P} AS doc_id, text, string_split(text, chr(10)) AS ls FROM documents), m AS (SELECT *, CASE WHEN ends_with(text, chr(10)) THEN len(ls) - 1 ELSE len(ls) END AS n FROM l),
        c AS (SELECT doc_id, text, CASE WHEN n < 4 THEN text ELSE array_to_string(ls[1 : greatest(1, floor(n * (0.55::DOUBLE + 0.2::DOUBLE * (({_h('doc_id', "'truncate-keep'")} % 1000)::DOUBLE / 1000)))::INT)], chr(10)) || chr(10) END AS short, n FROM m)
        SELECT doc_id, sha256(short) AS digest, short <> text AS cut FROM c""",
    "noise_hashed": f"""WITH c AS (SELECT {_P} AS doc_id, string_split(text, '') AS cs FROM documents)
        SELECT doc_id, sha256(array_to_string(list_transform(cs, lambda c, i: CASE WHEN {_SWAP}[c] IS NOT NULL THEN CASE WHEN ('0x' || substr(sha256('{SEED}|' || doc_id || '|noise|' || (i - 1)), 1, 16))::UBIGINT % 10000 < 2000 THEN {_SWAP}[c] ELSE c END ELSE c END), '')) AS noisy_sha256 FROM c""",
    "slot_allocation": f"SELECT number, count FROM ({_ALLOC})",
    "slot_manifest": f"""WITH p AS (SELECT number, dir_name, count, unnest(range(0, count::BIGINT)) AS pos FROM ({_ALLOC})), q AS (SELECT *, pos % 3 + 1 AS sub, pos // 3 + 1 AS ordinal, ['one', 'two', 'three'][pos % 3 + 1] AS name FROM p)
        SELECT number || '.' || sub || '.' || ordinal AS slot_id, CASE WHEN pos < greatest(1, round_even(count * 0.35, 0)) THEN 'A' ELSE 'F' END AS tier,
        dir_name || '/' || number || '.' || sub || '_' || name || '/' || number || '.' || sub || '.' || ordinal || '_' || name || '-' || lpad(ordinal::VARCHAR, 2, '0') || '.md' AS rel_path FROM q""",
    "authoring_order": "SELECT p_partkey AS rel_path, row_number() OVER (ORDER BY p_partkey % 31 <> 0, p_partkey % 7 <> 0, p_size <= 25, p_partkey) AS rank FROM part",
    "severity_targets": f"""WITH t AS (SELECT 4::BIGINT AS total UNION SELECT n FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) WHERE n >= 4), w(severity, w) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in O.SEVERITY_SHARES)}),
        f AS (SELECT total, severity, w, total * w // (SELECT sum(w) FROM w) AS whole, total * w % (SELECT sum(w) FROM w) AS rest FROM t, w),
        g AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY total ORDER BY rest DESC, w DESC, severity) <= total - sum(whole) OVER (PARTITION BY total) THEN 1 ELSE 0 END AS n FROM f),
        h AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY total) AS empty, row_number() OVER (PARTITION BY total ORDER BY n DESC, w, list_position(['critical', 'high', 'medium', 'low'], severity)) AS place FROM g)
        SELECT total::INT AS total, severity, (CASE WHEN n = 0 THEN 1 WHEN place = 1 THEN n - empty ELSE n END)::INT AS target FROM h""",
    "id_allocation": """WITH f AS (SELECT (c_custkey % 5)::VARCHAR AS label, 'NEW-' || lpad(c_custkey::VARCHAR, 6, '0') AS provisional_id, left(c_mktsegment, 3) AS prefix FROM customer WHERE c_custkey % 2 = 0),
        o AS (SELECT left(c_mktsegment, 3) AS prefix, max(c_custkey) AS most FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1)
        SELECT provisional_id, prefix || '-' || (coalesce(most, 0) + row_number() OVER (PARTITION BY prefix ORDER BY label, provisional_id)) AS finding_id FROM f LEFT JOIN o USING (prefix)""",
    "budget_batches": """WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
        b AS (SELECT p_brand, p_partkey, r, p_size::BIGINT AS load, 0 AS batch FROM p WHERE r = 1 UNION ALL
        SELECT p.p_brand, p.p_partkey, p.r, CASE WHEN b.load + p.p_size > 100 THEN p.p_size ELSE b.load + p.p_size END, CASE WHEN b.load + p.p_size > 100 THEN b.batch + 1 ELSE b.batch END FROM b JOIN p ON p.p_brand = b.p_brand AND p.r = b.r + 1)
        SELECT p_brand, p_partkey, batch FROM b""",
    "house_families": "SELECT p_partkey AS rel_path, house FROM (SELECT p_partkey, count(*) OVER w AS n, min(p_partkey) OVER w AS house FROM part WINDOW w AS (PARTITION BY p_brand, p_type)) WHERE n >= 3",
    "note_asymmetry": """WITH g AS (SELECT source AS section, count(*) FILTER (lang = 'en') AS evidence, count(*) FILTER (lang = 'en' AND contains(text, 'the')) AS evidence_notes, count(*) FILTER (lang <> 'en') AS other, count(*) FILTER (lang <> 'en' AND contains(text, 'the')) AS other_notes FROM documents GROUP BY 1)
        SELECT *, abs(evidence_notes / evidence - other_notes / other) AS gap FROM g WHERE evidence >= 3 AND other >= 3 AND abs(evidence_notes / evidence - other_notes / other) >= 0.5""",
    "section_habits": """SELECT section, target, documents FROM (SELECT event_type AS section, event_id % 20 AS target, count(DISTINCT user_id) AS documents FROM events GROUP BY 1, 2) JOIN (SELECT event_type AS section, count(DISTINCT user_id) AS size FROM events GROUP BY 1) USING (section) WHERE documents >= greatest(3, size * 0.3)""",
    "turn_pointer_direction": """SELECT a.conv_id, a.turn AS a, b.turn AS b, CASE WHEN a.conv_id % 3 = 0 AND (a.role = 'user') <> (b.role = 'user') THEN CASE WHEN a.role = 'user' THEN 'forward' ELSE 'backward' END
        WHEN a.conv_id % 2 = 0 THEN CASE WHEN a.turn // 2 = b.turn // 2 THEN 'lateral' WHEN b.turn // 2 > a.turn // 2 THEN 'forward' ELSE 'backward' END WHEN b.role = 'user' THEN 'backward' ELSE 'forward' END AS direction
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn""",
    "wave_consolidate": """SELECT 'F-' || o_orderkey AS finding_id, o_orderstatus AS title, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 36 <> 0 THEN true WHEN o_orderkey % 4 = 0 THEN false END AS discoverable_from_blind,
        CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 36 <> 0 THEN o_orderpriority END AS audit_note FROM orders""",
    "label_conflicts": "SELECT path, array_to_string(list_sort(list(DISTINCT lang)), ',') AS types FROM (SELECT source || '/' || (doc_id % 40) AS path, lang FROM documents) GROUP BY 1 HAVING count(DISTINCT lang) > 1",
}
