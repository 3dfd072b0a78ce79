"""Answer keys, lenient readers, ranks, names, references and trees on small cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyroom import cli
from tallyroom.functions import text as T
from tallyroom.operators import answerkey as K
from tallyroom.operators import audit, candidates, classify, importer, order, ranks
from tallyroom.sources import lenient as L
from tallyroom.sources import room as R
from tallyroom.sources import sinks, trees, word


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Answer keys

SECTIONS = [("01_corporate", "corp"), ("02_finance", "fin"), ("02_finance/2.1_tax", "tax"), ("03_bare", None)]


def sections(spark):
    return table(spark, SECTIONS, "dir_name string, classifier_workstream string")


def judged(spark, docs, labels, vocabulary=None):
    listed = table(spark, [(x,) for x in vocabulary], "name string") if vocabulary else None
    return K.judged(table(spark, [(d,) for d in docs], "rel_path string"), table(spark, labels, "path string, document_type string"), sections(spark), listed)


def told(rows):
    return {r["rule"]: (r["n"], r["named"]) for r in K.breaches(rows).collect()}


def test_a_whole_key(spark):
    docs = ["01_corporate/1.1.1_a.md", "02_finance/2.1_tax/x.csv", "02_finance/2.10_other/y.md"]
    rows = judged(spark, docs, [(d, "Deed") for d in docs], ["Deed"])
    assert told(rows) == {}
    found = K.records(rows).orderBy("source_path").collect()
    assert [(r[0], r[1], r[2], r[3]) for r in found] == [(docs[0], "Deed", "corp", []), (docs[2], "Deed", "fin", []), (docs[1], "Deed", "tax", [])]


def test_every_rule_names_what_breaks_it(spark):
    docs = ["01_corporate/a.md", "01_corporate/b.md", "03_bare/c.md", "09_none/d.md", "loose.md"]
    labels = [("01_corporate/a.md", "NDA"), ("01_corporate/a.md", "NDA"), ("03_bare/c.md", "Deed"), ("09_none/d.md", "Deed"), ("loose.md", "deed"), ("gone.md", "Deed"), ("", "Deed"), (None, None), ("01_corporate/z.md", " ")]
    rows = judged(spark, docs, labels, ["Deed"])
    assert told(rows) == {
        "labelled twice": (1, "01_corporate/a.md"), "outside the vocabulary": (2, "NDA, deed"), "without a label": (1, "01_corporate/b.md"), "without a document": (2, "01_corporate/z.md, gone.md"),
        "unknown section": (2, "09_none, loose.md"), "section without a workstream": (1, "03_bare"), "incomplete label": (2, ", 01_corporate/z.md")}
    assert K.records(rows).count() == 0
    assert "outside the vocabulary" not in told(judged(spark, docs, labels))
    assert K.judged(table(spark, [], "rel_path string"), table(spark, [], "path string, document_type string"), sections(spark)).count() == 0


def test_many_breaches_are_counted_and_few_are_named(spark):
    docs = spark.range(5000).select(F.format_string("01_corporate/%05d.md", "id").alias("rel_path"))
    rows = K.judged(docs, table(spark, [], "path string, document_type string"), sections(spark))
    ((rule, n, named),) = K.breaches(rows).collect()
    assert (rule, n) == ("without a label", 5000) and named.startswith("01_corporate/00000.md, ") and named.endswith("00009.md (+4990 more)")


def test_drift_is_grouped_by_type_and_agrees_with_the_build(spark):
    labels = [("b.md", "NDA"), ("a.md", "NDA"), ("c.md", "Deed"), ("d.md", "deed")]
    drift = K.label_drift(table(spark, labels, "path string, document_type string"), table(spark, [("Deed",)], "name string"))
    assert {r[0]: (r[1], r[2]) for r in drift.collect()} == {"NDA": (2, "a.md, b.md"), "deed": (1, "d.md")}


def test_evidence_outside_sections(spark):
    findings = table(spark, [("A", "01_corporate/a.md", ["04_gone/b.md"]), ("B", "02_finance/x.md", [])], "finding_id string, source string, corroboration array<string>")
    traps = table(spark, [("D", "05_gone/l.md", "06_gone/r.md"), ("E", "01_corporate/l.md", "01_corporate")], "distractor_id string, location string, resolution string")
    assert sorted(r[0] for r in K.outside_sections(findings, traps, sections(spark)).collect()) == ["04_gone/b.md", "05_gone/l.md", "06_gone/r.md"]


@pytest.mark.parametrize("text", ["plain", 'a"b\\c\n\r\t\b\f\x01\x1f\x7f', "é ß 漢 😀  ", ""])
def test_json_texts(spark, text):
    row = table(spark, [(text, None)], "x string, y string").select(T.json_quoted(F.col("x")), T.json_quoted(F.col("y"))).first()
    assert tuple(row) == (json.dumps(text), "null")


# Lenient readers


def test_damaged_lines_are_named_and_the_rest_is_read(spark, tmp_path):
    lines = [json.dumps({"source_path": f"a/{i}.md", "document_type": "x" * 30, "room_hash": "h"}) if i % 7 else "" for i in range(3000)]
    lines[100], lines[1234], lines[2001], lines[2500], lines[2501] = "{bad", "[1]", json.dumps({"source_path": "a/1.md"}), json.dumps({"document_type": "q"}), json.dumps({"source_path": "a/x.md", "unsure": "no"})
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        assert {r["line"]: r["value"] for r in L.numbered_lines(spark, str(tmp_path / "m.jsonl")).collect()} == dict(enumerate(lines, 1))
        rows = L.classified(spark, str(tmp_path / "m.jsonl"))
        assert {r["error"]: r["named"] for r in L.faults(rows).collect()} == {"not valid JSON": "101", "not an object": "1235", "classified twice": "2002", "no source_path": "2501", "a field of the wrong kind": "2502"}
        assert rows.where("error IS NULL").count() == sum(bool(x) for x in lines) - 5
        assert R.agreed_hash(rows) == "h"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with pytest.raises(R.RoomError, match="not valid JSON: 1 .at 101."):
        L.sound(rows, "m.jsonl")


def test_whole_objects(spark, tmp_path):
    at = tmp_path / "o.json"
    at.write_text(json.dumps({"tool": "t", "room_hash": "h", "classifications": [{"source_path": "a"}, {"source_path": "a"}, {"document_type": "x"}]}, indent=1))
    assert {r["error"]: r["named"] for r in L.faults(L.classified(spark, str(at))).collect()} == {"classified twice": "1", "no source_path": "2"}
    for bad in ("[]", "{", '{"classifications": []}', '{"tool": "t"}'):
        at.write_text(bad)
        with pytest.raises(R.RoomError):
            L.classified(spark, str(at))
    (tmp_path / "e.jsonl").write_text("\n\n")
    with pytest.raises(R.RoomError, match="no records"):
        L.sound(L.classified(spark, str(tmp_path / "e.jsonl")), "e")


@pytest.mark.parametrize(("sheet", "fault"), [
    ("# nothing", None), ("## Canonical figures\n\nnone", "a heading without a table"), ("## Canonical figures\n| Key | Value |\n|---|---|\n| a | 1 |\n", "a header of fewer than three columns"),
    ("## Canonical figures\n| Key | Value | Superseded |\n|---|---|---|\n", "a header without rows"), ("## Canonical figures\n| Key | Value | Superseded |\n| a | 1 |\n", "rows of fewer than three columns"),
    ("## Canonical figures\n| Key | Value | Superseded |\n|---|---|---|\n| a | 1 | - |\n", None),
])
def test_faults_of_figure_tables(spark, sheet, fault):
    assert L.figures_fault(table(spark, [(sheet,)], "text string")).first()["fault"] == fault


# Ranks


def test_ranks_and_carried_values_without_one_task(spark):
    df = spark.range(0, 6000, 1, 5).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.when(F.col("id") % 37 == 0, F.col("id")).alias("v"), F.hash("id").alias("o"))
    rows = df.toPandas().sort_values(["o", "id"])
    want = {i: k + 1 for k, i in enumerate(rows["id"].tolist())}
    assert {r["id"]: r["rank"] for r in ranks.ranked(df, "o", "id", ranges=16).collect()} == want
    seen, by_group, last = {}, {}, {}
    for g, i, v in zip(rows["g"].where(rows["g"].notna(), None), rows["id"].tolist(), rows["v"].tolist()):
        seen[g] = seen.get(g, 0) + 1
        last[g] = int(v) if v == v else last.get(g)
        by_group[i] = (seen[g], last[g])
    both = ranks.carried(ranks.ranked(df, "o", "id", by=("g",), ranges=16), "v", "o", "id", by=("g",), ranges=16)
    assert {r["id"]: (r["rank"], r["carried"]) for r in both.collect()} == by_group
    assert ranks.ranked(df.limit(0), "o").count() == 0 and ranks.ranked(df.limit(1), "o").first()["rank"] == 1


def test_moved_rows(spark):
    want = table(spark, [(x,) for x in "abcdef"], "k string")
    have = table(spark, [(k, i) for i, k in enumerate("abdcexf")], "k string, line int")
    assert sorted(r[0] for r in audit.moved_rows(want, have, "k", "line").collect()) == ["c", "d", "e"]
    assert audit.moved_rows(want, table(spark, [("a", 3), ("c", 7)], "k string, line int"), "k", "line").count() == 0


def test_severity_targets_are_columns(spark):
    found = {}
    for r in order.severity_targets(table(spark, [(x,) for x in (3, 4, 5, 11, 25, 60, 110)], "total long")).collect():
        found.setdefault(r["total"], {})[r["severity"]] = r["target"]
    assert found == {t: dict(zip(("critical", "high", "medium", "low"), x)) for t, x in {4: (1, 1, 1, 1), 5: (1, 1, 2, 1), 11: (1, 3, 4, 3), 25: (2, 7, 9, 7), 60: (6, 16, 22, 16), 110: (10, 30, 40, 30)}.items()}


def test_archetypes_and_floors(spark):
    docs = table(spark, [("a/share-purchase-agreement-01.md",), ("a/purchase.md",), ("a/letter.md",)], "rel_path string")
    patterns = table(spark, [("purchase", "buy", 100), ("share-purchase", "spa", 50), ("purchase", "acquire", 200), ("", "none", 1)], "pattern string, archetype string, floor int")
    found = audit.archetypes(docs, patterns, "other")
    assert {r[0]: r[1] for r in found.collect()} == {"a/share-purchase-agreement-01.md": "spa", "a/purchase.md": "acquire", "a/letter.md": "other"}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    slots = table(spark, [("a/share-purchase-agreement-01.md", "A", "s", "x"), ("a/purchase.md", "F", "s", "y"), ("a/letter.md", "A", "s", "y")], "rel_path string, tier string, section string, subsection string")
    of = table(spark, [("spa", 900)], "archetype string, floor int")
    assert {r[0][2:5]: r[1] for r in audit.floors(slots, found, of, 350).collect()} == {"sha": 900, "pur": 350, "let": 350}
    band = table(spark, [("s", "y", 2000)], "section string, subsection string, floor int")
    assert {r[0][2:5]: r[1] for r in audit.floors(slots, found, of, 350, band).collect()} == {"sha": 900, "pur": 2000, "let": 2000}


def test_floors_send_no_documents_to_every_task(spark, tmp_path):
    """Packed names take little of a file, so a plan takes them for small; only the two small tables may be broadcast."""
    slots = spark.range(3000).select(F.concat(F.lit("a/"), "id", F.when(F.col("id") % 3 == 0, "_purchase.md").otherwise("_letter.md")).alias("rel_path"), F.when(F.col("id") % 2 == 0, "A").otherwise("F").alias("tier"))
    slots.write.parquet(str(tmp_path / "slots"))
    slots = spark.read.parquet(str(tmp_path / "slots"))
    patterns = table(spark, [("purchase", "buy", 100)], "pattern string, archetype string, floor int")
    found = audit.floors(slots, audit.archetypes(slots, patterns, "other"), patterns.select("archetype", "floor"), 350)
    assert {tuple(r) for r in found.groupBy("floor").count().collect()} == {(100, 500), (350, 2500)}
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan


# References and names


def test_references_in_place(spark):
    text = "1.1.1 Intro\nsee 2.2.2 and clause 3.3.3, 4.4.4 and 5.5.5; **6.6.6** x\n- 7.7.7 y\n## 8.8.8\nSchedule 9.9.9(a) to 10.1.1 in v1.2.3.4\n| 4.5.6 |\n**4.4.4** apart 3.1.1, rules 3.1.2"
    got = table(spark, [(text,)], "t string").select(F.explode(T.refs_in_place(F.col("t"))).alias("x")).select("x.*", T.is_clause_number(F.col("x.left")).alias("clause")).collect()
    assert [(r["ref"], r["clause"]) for r in got] == [("1.1.1", True), ("2.2.2", False), ("3.3.3", True), ("4.4.4", True), ("5.5.5", True), ("6.6.6", False), ("7.7.7", False), ("8.8.8", True), ("9.9.9", True), ("10.1.1", True), ("2.3.4", False), ("4.5.6", False), ("4.4.4", True), ("3.1.1", False), ("3.1.2", True)]
    assert got[1]["left"] == "1.1.1 Intro\nsee " and got[1]["right"].startswith(" and clause")


def test_dangling_and_out_of_range(spark):
    docs = table(spark, [("01_a/1.1.1_x.md", "see 1.1.1, 1.1.2, 1.9.9, 2.7.7 and 24.08.26; clause 1.8.8"), ("01_a/1.1.2_y.md", None), ("01_a/1.1.3_z.md", "")], "rel_path string, text string")
    found = audit.checked_references(docs, table(spark, [("1.1.2",)], "slot_id string"), table(spark, [(1,), (2,)], "number int"), ["2.7.7"])
    assert sorted((r["ref"], r["problem"]) for r in found.collect()) == [("1.9.9", "dangling"), ("24.08.26", "out of range")]


def test_candidates_of_a_fact_sheet(spark):
    sheet = "Prose of Kessler Werke GmbH and Ada Lovelace Ltd.\n## Cast\n| Name | Role |\n|---|---|\n| Ada Lovelace | chair |\n| Bob Roe | clerk |\n| Kessler Werke GmbH | odd |\n## Other\n| Nobody | x |\n## Invented names, more\n| Name | Kind |\n|:-:|---|\n| Sparkle | Brand |\n| Bob Roe | site |\n| Two | site |\n| Two | domain |\n| Blank | |\n| Odd | thing |\n| Ada Lovelace Ltd | product |\n### end\n| Late | brand |\n"
    found = {r["name"]: (r["kind"], r["fault"]) for r in candidates.candidates(table(spark, [("f", sheet)], "rel_path string, text string")).collect()}
    assert found == {
        "Kessler Werke GmbH": ("entity", None), "Ada Lovelace Ltd": ("product", None), "Ada Lovelace": ("person", None), "Bob Roe": ("site", "in the cast, but not declared a person"), "Sparkle": ("brand", None),
        "Two": ("site", "two kinds"), "Blank": ("", "no kind"), "Odd": ("thing", "unknown kind")}


def test_name_checks_are_read_back(spark):
    rows = [("Kessler Werke GmbH", "entity", "clear", "2024-01-01", "no | bars\nhere"), ("Sparkle", "brand", "collision", "2024-01-02", None)]
    kind = "name string, kind string, verdict string, checked string, note string"
    good = table(spark, rows, kind)
    assert candidates.unwritable(good).count() == 0
    text = "# check\n\n| Name | Kind | Verdict | Checked | Note |\n|---|---|---|---|---|\n" + "\n".join(r["line"] for r in candidates.name_check_lines(good).collect())
    assert sorted(map(tuple, R.name_verdicts(spark, text).collect())) == [(*rows[0][:4], "no / bars here"), (*rows[1][:4], "")]
    bad = table(spark, [("a|b c", "site", "clear", "", ""), ("GmbH", "entity", "clear", "", ""), ("Word", "entity", "clear", "", ""), ("Two Words", "entity", "claer", "", ""), ("Name", "site", "clear", "", ""), (" x", "site", "clear", "", "")], kind)
    assert {r[0]: r[1] for r in candidates.unwritable(bad).collect()} == {"a|b c": "does not survive the table", "GmbH": "an entity of one word", "Word": "an entity of one word", "Two Words": "unknown verdict", "Name": "does not survive the table", " x": "does not survive the table"}


@pytest.mark.parametrize(("text", "want"), [
    ("A B C D E F GmbH", ["C D E F GmbH"]), ("Alpha SA Beta Ltd x", ["Alpha SA Beta Ltd"]), ("Müller Werke Ltd's", ["Müller Werke Ltd"]), ("Foo\n\nBar Ltd", ["Bar Ltd"]), ("Foo \n Bar Ltd", ["Foo Bar Ltd"]), ("X O'Neil & Sons LLP", ["Sons LLP"]),
    ("O'Neil Sons LLP", ["O'Neil Sons LLP"]), ("The Ltd. The Big Ltd", ["Big Ltd", "The Ltd"]), ("Delta Limited by", []), ("'Quoted Name PLC'", ["Quoted Name PLC"]), ("Beta incorporated", []), ("", []),
])
def test_entities_word_by_word(spark, text, want):
    assert table(spark, [(text,)], "t string").select(T.entity_tokens(F.col("t"))).first()[0] == want


def test_masks_keep_to_whole_words_and_the_longest_name(spark):
    text = "alpha\nBETA gamma, Betamax; beta  gamma delta; A.B. Co.x (Beta)"
    assert table(spark, [(text,)], "t string").select(T.mask_names(F.col("t"), ["Alpha Beta", "beta gamma delta", "Beta", "A.B. Co"])).first()[0] == "  gamma, Betamax;  ;  .x ( )"


# Trees


def tree_of(spark, root):
    return {r["rel_path"]: bytes(r["content"]) for r in R.tree(spark, f"file://{root}").collect()}


def test_trees_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"{i % 3}_s/é {i}.md", f"text {i}".encode()) for i in range(40)] + [("empty.bin", b""), ("n.bin", None)]
    files = table(spark, rows, "rel_path string, content binary").repartition(5)
    trees.write_tree(files, f"file://{tmp_path}/a")
    assert tree_of(spark, tmp_path / "a") == {p: c for p, c in rows if c}
    assert (tmp_path / "a/empty.bin").read_bytes() == (tmp_path / "a/n.bin").read_bytes() == b""
    hash_of = lambda df: audit.content_hash(df).first()["content_hash"]
    assert hash_of(R.tree(spark, f"file://{tmp_path}/a")) == hash_of(files.where("length(content) > 0"))
    for bad in ([("x.md", b"1"), ("x.md", b"2")], [("a/ok.md", b"1"), ("../x.md", b"2")], [("/x.md", b"")]):
        target = tmp_path / "b"
        with pytest.raises(Exception):
            trees.publish(spark, str(target), lambda folder: trees.write_tree(table(spark, bad, "rel_path string, content binary"), folder))
        assert not target.exists() and not list(tmp_path.glob("b.partial*"))


DOCS = {f"{s}/{i}.1.{k}_paper-{k}.md": "The old boiler is loose.\n" * 40 + f"{i} {k}\n" for i, s in enumerate(("01_corporate", "02_finance"), 1) for k in range(1, 21)}
KEY_ROWS = [(p, "Deed", "corp" if p < "02" else "fin") for p in DOCS]


def test_the_corrupted_twin(spark, tmp_path):
    docs = table(spark, list(DOCS.items()), "rel_path string, text string")
    others = table(spark, [("index.bin", b"\xff\x00")], "rel_path string, content binary")
    key = table(spark, KEY_ROWS, "source_path string, document_type string, primary_workstream string")
    sections_ = ["01_corporate", "02_finance"]
    report = trees.write_corrupted(docs, others, key, str(tmp_path / "twin"), "ROOM", 7, "heavy", sections_, "abc")
    written = tree_of(spark, tmp_path / "twin/blind")
    records = L.key_rows(spark, str(tmp_path / "twin/answer-key.jsonl")).orderBy("source_path").collect()
    assert {r["source_path"] for r in records} == written.keys() - {"index.bin"} and written["index.bin"] == b"\xff\x00"
    log = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "twin/log.jsonl")).collect()]
    assert {x["original"] for x in log} == DOCS.keys() and report["documents"] == 40
    for said, word in (("renamed", "renamed"), ("misfiled", "misfiled"), ("noised", "ocr-noise"), ("truncated", "truncated")):
        assert report[said] == sum(word in x["applied"] for x in log)
    assert report["renamed"] > 5 and report["noised"] > 3
    by_new = {x["corrupted"]: x for x in log}
    for r in records:
        assert r["primary_workstream"] == ("corp" if by_new[r["source_path"]]["original"] < "02" else "fin")
        if not by_new[r["source_path"]]["applied"]:
            assert written[r["source_path"]].decode() == DOCS[r["source_path"]]
    manifest = json.loads((tmp_path / "twin/manifest.json").read_text())
    whole = audit.content_hash(R.tree(spark, f"file://{tmp_path}/twin/blind")).first()
    assert manifest == {"room": "ROOM", "content_hash": whole["content_hash"], "documents": whole["documents"], "seed": 7, "derived_from": "abc"}
    with pytest.raises(R.RoomError, match="there already"):
        trees.write_corrupted(docs, others, key, str(tmp_path / "twin"), "ROOM", 7, "heavy", sections_)
    with pytest.raises(R.RoomError, match="1 records without"):
        trees.write_corrupted(docs, others, key.union(table(spark, [("x.md", "a", "b")], key.schema)), str(tmp_path / "no"), "ROOM", 7, "heavy", sections_)
    assert not (tmp_path / "no").exists()


def test_texts_are_not_dealt_out_for_a_report(spark, tmp_path):
    """Counting what was done takes the texts through no shuffle."""
    paths = spark.range(300).select(F.concat(F.lit("0"), F.col("id") % 3, F.lit("_s/"), F.md5(F.col("id").cast("string")), F.lit(".md")).alias("rel_path"), F.repeat(F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("\n")), F.lit(300)).alias("text"))
    paths.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = docs.select(F.col("rel_path").alias("source_path"), F.lit("Deed").alias("document_type"), F.lit("corp").alias("primary_workstream"))
    report = trees.corruption_report(trees.corrupted(docs, key, 7, "heavy", ["00_s", "01_s", "02_s"]))
    found = report.first().asDict()
    assert found["documents"] == 300 and found["truncated"] > 5 and found["noised"] > 50

    def dealt(node):
        """What comes into joins, windows and groupings."""
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [k.output().mkString(" ") for k in below] if node.nodeName() in ("Join", "Window", "FlatMapGroupsInPandas") else []
        return own + [x for k in below for x in dealt(k)]

    columns = dealt(report._jdf.queryExecution().optimizedPlan())
    assert len(columns) > 5 and not any("text#" in x or "_noisy#" in x for x in columns)


FINDING_ROWS = [("F-1", "One", "high", "w", True, "01_corporate/1.1.1_paper-1.md", "l", "Said so", ["02_finance/2.1.2_paper-2.md"], [], True, None), ("F-2", "Two", "low", "w", False, "01_corporate/1.1.1_paper-1.md", "l", "And so", [], [], True, None), ("F-3", "Three", "low", "w", False, "gone.md", "l", "No", [], [], True, None)]


def test_subset_and_flagged_trees(spark, tmp_path):
    files = table(spark, [(p, t.encode()) for p, t in DOCS.items()] + [("x.csv", b"a,b\xff")], "rel_path string, content binary")
    findings = table(spark, FINDING_ROWS, R.FINDING)
    assert trees.write_subset(files, findings, 9, str(tmp_path / "sub"), "ROOM") == {"documents": 9, "findings": 2}
    listed = [r[0].rsplit(",", 1) for r in spark.read.text(str(tmp_path / "sub/subset-manifest.csv")).collect()]
    assert tree_of(spark, tmp_path / "sub/subset").keys() == {p for p, _ in listed} and sum(r == "evidence" for _, r in listed) == 2
    told_ = (tmp_path / "sub/subset-key.yaml").read_text()
    assert "F-1" in told_ and "F-3" not in told_ and "subset_documents: 9" in told_
    none = table(spark, [], R.DISTRACTOR)
    with pytest.raises(R.RoomError, match="gone.md"):
        trees.write_flagged(files, findings, none, str(tmp_path / "flagged"), "## FLAG")
    found = findings.where("finding_id <> 'F-3'")
    assert trees.write_flagged(files, found, none, str(tmp_path / "flagged"), "## FLAG") == {"written": 41, "carriers": 2, "identical": 39}
    got = tree_of(spark, tmp_path / "flagged")
    assert got["x.csv"] == b"a,b\xff" and got["01_corporate/1.1.1_paper-1.md"].decode().endswith("\n## FLAG\n- **F-1 (One)** Said so\n- **F-2 (Two)** And so\n")
    blind = R.tree(spark, f"file://{tmp_path}/flagged")
    assert audit.twin_diff(files.where("rel_path <> 'x.csv'").select("rel_path", F.col("content").cast("string").alias("text")), blind.select("rel_path", "text"), "## FLAG").count() == 0


# The shell

CONF = 'ROOM_CODENAME="ROOM"\nINDEX_TOTAL="40"\nBLIND_TOTAL="40"\nFLAGGED_TOTAL="40"\nBLIND_TREE="blind"\nFLAGGED_TREE="flagged"\nKEY_ROOT="_key"\nFLAG_STRING_1="## FLAG"\nFLAG_STRING_2="zz"\nFINDING_PREFIXES="F"\nEXPECTED_KDP_CARRIERS="2"\nSECTION_DIRS="01_corporate 02_finance"\nROOM_ROLE="eval"\n'


def a_room(tmp_path):
    for p, t in DOCS.items():
        at = tmp_path / "blind" / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(t)
    (tmp_path / "_key").mkdir()
    (tmp_path / "room.conf").write_text(CONF)
    (tmp_path / "_key/labels.yaml").write_text("labels:\n" + "".join(f"- {{path: {p}, document_type: Deed}}\n" for p in DOCS))
    (tmp_path / "sections.yaml").write_text("sections:\n- {number: 1, dir_name: 01_corporate, title: a, workstream: w, weight: 0.5, subsections: [x], classifier_workstream: corp}\n- {number: 2, dir_name: 02_finance, title: b, workstream: w, weight: 0.5, subsections: [x], classifier_workstream: fin}\n")
    (tmp_path / "_key/findings.yaml").write_text("findings: []\n")
    (tmp_path / "_key/distractors.yaml").write_text("distractors: []\n")
    return str(tmp_path)


def test_key_and_score_from_the_shell(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    room = a_room(tmp_path)
    output = tmp_path / "tool.jsonl"
    assert cli.main(["classify", "--room", room, str(output)]) == 2 and "answerkey" in capsys.readouterr().err
    (tmp_path / "_key/classifier-vocab.txt").write_text("# list\n\nLease\n")
    assert cli.main(["answerkey", "--room", room]) == 1 and "outside the vocabulary: 1 (Deed)" in capsys.readouterr().err
    (tmp_path / "good.txt").write_text("Deed\n")
    assert cli.main(["answerkey", "--room", room, "--vocabulary", str(tmp_path / "good.txt")]) == 0 and "40 records" in capsys.readouterr().out
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "_key/answer-key.jsonl")).collect()]
    assert lines == [{"source_path": p, "document_type": "Deed", "primary_workstream": w, "secondary_workstreams": []} for p, _, w in sorted(KEY_ROWS)]
    (tmp_path / "_key/classifier-vocab.txt").unlink()
    loaded = cli._room(spark, room)
    assert G_eval(loaded) == "PASS"
    rows = [{"source_path": p, "document_type": "Deed", "primary_workstream": "corp", "unsure": i == 0, "room_hash": "h"} for i, (p, _, _) in enumerate(KEY_ROWS)]
    output.write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert cli.main(["classify", "--room", room, str(output)]) == 0
    card = capsys.readouterr().out
    assert "provenance: unverified" in card and "workstream right: 48% (19/40)" in card and "| fin | 20 | 0% | 0 | - |" in card and "| fin | corp | 20 |" in card and "| corp | (not sure) | 1 |" in card
    (tmp_path / "_key/manifest.json").write_text(json.dumps({"content_hash": "other"}))
    assert cli.main(["classify", "--room", room, str(output)]) == 2
    (tmp_path / "_key/manifest.json").write_text(json.dumps({"content_hash": "h"}))
    assert cli.main(["classify", "--room", room, str(output)]) == 0 and "provenance: verified" in capsys.readouterr().out
    output.write_text("".join(json.dumps(r) + "\n" for r in rows[1:]))
    assert cli.main(["classify", "--room", room, str(output)]) == 2 and "missing: 1 (01_corporate/1.1.1_paper-1.md)" in capsys.readouterr().err
    assert cli.main(["corrupt", "--room", room, "--out", str(tmp_path / "corrupted"), "--seed", "3"]) == 0
    assert cli.main(["subset", "--room", room, "--out", str(tmp_path / "some"), "--total", "5"]) == 0
    assert cli.main(["flag", "--room", room, "--out", str(tmp_path / "marked")]) == 0


def G_eval(room):
    from tallyroom import gates

    found = {r["gate"]: r for r in gates.run(room, {19: gates.GATES[19]}).collect()}
    return found[19]["status"]


def test_confusion_with_its_remainder(spark):
    pairs = table(spark, [(f"e{i}", f"p{k}", i) for i in range(5) for k in range(4) for _ in range(i + 1)], "expected string, predicted string, n int").withColumn("unsure", F.lit(False)).withColumn("document_type", F.lit("a")).withColumn("said_type", F.lit("a"))
    shown = classify.confusion_shown(pairs, 15).collect()
    assert len(shown) == 15 and {r["left"] for r in shown} == {5}
    assert "| … | … | +5 more pairs |" in sinks.classification_text(pairs, "t", "unverified")


# Word reports

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def word_file(body, styles=(("H1", "heading 1"), ("H2", "Heading 2"), ("L", "List Bullet"), ("T", "Title")), links=(("r1", "01_a/x y.md"),)):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>" + "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles) + "</w:styles>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in links) + "</Relationships>")
    return out.getvalue()


def par(text, style=None):
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + "".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in text.split("~")) + "</w:p>"


def test_word_reports(spark, tmp_path, monkeypatch, capsys):
    link = '<w:p><w:r><w:t>see </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>the deed</w:t></w:r></w:hyperlink></w:p>'
    table_ = "<w:tbl><w:tr><w:tc>" + par("not read") + "</w:tc></w:tr></w:tbl>"
    good = word_file(par("Report", "T") + par("", "H2") + par("Void ~issue", "H2") + par("HIGH risk &amp; more `01_corporate/1.1.1_paper-1.md`") + par("one", "L") + link + table_ + par("a<w:tab/>b".replace("<w:tab/>", "</w:t><w:tab/><w:t>")) + par("Deep", "H1"))
    rows = [("good.docx", good), ("bad.docx", b"PK no zip"), ("empty.docx", b""), ("null.docx", None), ("torn.docx", word_file(par("x"))[:-40]), ("plain.docx", word_file(""))]
    found = {r["rel_path"]: r for r in word.word_markdown(word.word_paragraphs(table(spark, rows, "rel_path string, content binary").repartition(3))).collect()}
    assert found["good.docx"]["text"] == "# Report\n\n## Void issue\nHIGH risk & more `01_corporate/1.1.1_paper-1.md`\n- one\nsee the deed (01_a/x y.md)\na\tb\n# Deep\n"
    assert found["good.docx"]["note"] == "tables that were not read: 1" and found["good.docx"]["error"] is None
    assert all(found[p]["error"] and found[p]["text"] is None for p in ("bad.docx", "empty.docx", "null.docx", "torn.docx")) and "plain.docx" not in found
    monkeypatch.setattr(cli, "session", lambda: spark)
    room = a_room(tmp_path)
    (tmp_path / "_key/findings.yaml").write_text("findings:\n- {id: F-1, title: t, severity: high, workstream: w, source: 01_corporate/1.1.1_paper-1.md, location: l, substance: s}\n- {id: F-2, title: t, severity: low, workstream: w, source: 02_finance/2.1.1_paper-1.md, location: l, substance: s}\n")
    (tmp_path / "r.docx").write_bytes(good)
    (tmp_path / "b.json").write_text(json.dumps({"room_hash": "h", "findings": [{"title": "x", "severity": "low", "documents": ["02_finance/2.1.1_paper-1.md"]}]}))
    assert cli.main(["score", "--room", room, str(tmp_path / "r.docx"), "--baseline", str(tmp_path / "b.json")]) == 0
    out = capsys.readouterr().out
    assert "provenance: unverified" in out and "recall 0.50" in out and "gained: F-1" in out and "lost: F-2" in out
    (tmp_path / "_key/manifest.json").write_text(json.dumps({"content_hash": "other"}))
    assert cli.main(["score", "--room", room, str(tmp_path / "b.json")]) == 2


def test_a_fact_sheet_that_contradicts_itself(spark):
    figures = table(spark, [("date", "31 March 2026", ["March 2026", "30 March"]), ("area", "3700m", ["700m"]), ("rent", "5", [])], "key string, value string, superseded array<string>")
    assert [tuple(r) for r in audit.contradictions(figures).collect()] == [("date", "March 2026")]


# Imports, key for people, scanned slots


@pytest.mark.parametrize(("head", "model", "skill"), [("**Model:** Big 3\nSkill: review\n", "Big 3", "review"), ("Model: Big 3, Skill: _review_", "Big 3", "review"), ("- Model: x\n", "x", ""), ("nothing", "", ""), ("text\n## Issue\nModel: late", "", "")])
def test_what_a_preamble_says(spark, head, model, skill):
    row = table(spark, [(head,)], "t string").select(importer.preamble_fields(F.col("t")).alias("f"), importer.names_room(F.col("t"), "Big").alias("big")).first()
    assert (row["f"]["model"], row["f"]["skill"]) == (model, skill) and row["big"] == ("Big" in head)


def test_an_import_from_the_shell(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    room = a_room(tmp_path)
    report = tmp_path / "review.md"
    report.write_text("Model: Big 3\n\n## Void\nHigh risk in `01_corporate/1.1.1_paper-1.md` and 01_corporate/gone.md here.\n## Loose\nLow, no path.\n# Files read\n- 01_corporate/1.1.1_paper-1.md\n- 01_corporate/1.1.2_paper-2.md\n")
    out = tmp_path / "out.json"
    assert cli.main(["import", "--room", room, "--out", str(out), str(report)]) == 2 and "not in the cut: 1 (01_corporate/gone.md)" in capsys.readouterr().err and not out.exists()
    assert cli.main(["import", "--room", room, "--out", str(out), "--drop-unknown", str(report)]) == 0
    said = capsys.readouterr().out
    assert "Imported 2 issues (critical 0, high 1, medium 0, low 1), citing 1 documents." in said and "Files read: 2 of 40 named; 38 not named, 18 of them beside one that is." in said and "1 issues cite no document" in said and "Dropped, not in the cut: 01_corporate/gone.md" in said
    told_ = json.loads(out.read_text())
    assert told_["tool"] == "Big 3" and [(f["title"], f["severity"], f["documents"]) for f in told_["findings"]] == [("Void", "high", ["01_corporate/1.1.1_paper-1.md"]), ("Loose", "low", [])]
    assert cli.main(["score", "--room", room, str(out)]) == 0
    report.write_text("## Void\nsee `_key/01_corporate/1.1.1_paper-1.md`\n")
    assert cli.main(["import", "--room", room, "--out", str(tmp_path / "no.json"), str(report)]) == 2 and "on the key's side" in capsys.readouterr().err
    assert cli.main(["import", "--room", room, "--out", str(tmp_path / "no.json"), "--cut", "none", str(report)]) == 2


def test_a_key_for_people(spark, tmp_path):
    flagged = table(spark, [(p, t.encode()) for p, t in DOCS.items()], "rel_path string, content binary")
    findings = table(spark, FINDING_ROWS[:2], R.FINDING)
    traps = table(spark, [("D-1", "Trap", "01_corporate/1.1.3_paper-3.md", "01_corporate/1.1.4_paper-4.md", "F-1")], R.DISTRACTOR)
    room = str(tmp_path / "room")
    assert trees.write_key(flagged, findings, traps, str(tmp_path / "key"), room) == {"findings": 2, "distractors": 1, "flagged": 4}
    assert tree_of(spark, tmp_path / "key/flagged").keys() == {"01_corporate/1.1.1_paper-1.md", "02_finance/2.1.2_paper-2.md", "01_corporate/1.1.3_paper-3.md", "01_corporate/1.1.4_paper-4.md"}
    assert (tmp_path / "key/findings.md").read_text().index("F-1") < (tmp_path / "key/findings.md").read_text().index("F-2") and "Shaped like F-1" in (tmp_path / "key/distractors.md").read_text()
    for target, frame in ((f"{room}/key", findings), (str(tmp_path / "no"), table(spark, FINDING_ROWS, R.FINDING))):
        with pytest.raises(R.RoomError):
            trees.write_key(flagged, frame, traps, target, room)
    assert not (tmp_path / "no").exists()


def test_scanned_slots(spark, tmp_path):
    trees.write_scanned(table(spark, [("1.1.2",), ("1.1.1",), ("1.1.2",)], "slot_id string"), str(tmp_path / "scanned.csv"))
    assert sorted(r[0] for r in trees.scanned(spark, str(tmp_path / "scanned.csv")).collect()) == ["1.1.1", "1.1.2"]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(R.RoomError):
        trees.scanned(spark, str(tmp_path / "bad.csv"))


def test_most_gates_skipped_is_said(spark):
    from tallyroom import gates

    rows = lambda *states: table(spark, [(i, "g", s, "") for i, s in enumerate(states)], "gate int, name string, status string, detail string")
    assert gates.summary(rows("PASS", "WARN")) == "2 gates run, 0 failed, 0 skipped, 1 warned; no hard failures"
    assert "MOST GATES SKIPPED (2/3)" in gates.summary(rows("PASS", "SKIP", "SKIP")) and "MOST" not in gates.summary(rows("PASS", "SKIP"))
    assert gates.summary(rows("FAIL", "SKIP", "SKIP"), True).endswith("2 skipped, 0 warned; skipped gates count as failures")
