"""A small room: what its key says, what a tool's reports score, and gates that must notice a break."""

import json

import pytest
from pyspark.sql import functions as F

from tallyroom import gates as G
from tallyroom.operators import match as M
from tallyroom.sources import room as R

CONF = """# a room
ROOM_CODENAME="Test"
INDEX_TOTAL="4"
BLIND_TOTAL=4
FLAGGED_TOTAL="4"
BLIND_TREE="blind"
FLAGGED_TREE="flagged"
KEY_ROOT="_key"
FLAG_STRING_1="## FLAG"
FLAG_STRING_2="FLAGGED"
FINDING_PREFIXES="CORP|FIN|COMM|ENV"
EXPECTED_KDP_CARRIERS="6"
SECTION_DIRS="01_corporate 02_financial"
ROOM_ROLE="exemplar"
"""

FINDINGS = """findings:
- {id: CORP-1, title: Share issue void, severity: critical, workstream: corporate, source: 01_corporate/1.1.1_a.md, location: cl 1, substance: void issue, discoverable_from_blind: true}
- {id: FIN-1, title: Loan undisclosed, severity: high, workstream: financial, source: 02_financial/2.1.1_b.md, location: p 2, substance: loan, discoverable_from_blind: true}
- {id: COMM-1, title: Change of control, severity: medium, workstream: commercial, multi_document: true, source: 01_corporate/1.1.2_c.md, corroboration: [02_financial/2.1.2_d.md], location: cl 9, substance: consent, discoverable_from_blind: true}
- {id: ENV-1, title: Permit lapsed, severity: low, workstream: environmental, multi_document: true, source: 02_financial/2.1.1_b.md, corroboration: [01_corporate/1.1.1_a.md], location: s 1, substance: permit, discoverable_from_blind: true, cross_links: [COMM-1]}
"""

DISTRACTORS = """distractors:
- {id: DX-1, title: Old charge, location: 02_financial/2.9.9_x.md, resolution: 01_corporate/1.1.1_a.md, shape_matches: FIN-1}
- {id: DX-2, title: Threat, location: 02_financial/2.9.8_y.md, resolution: 01_corporate/1.1.2_c.md}
"""

PATHS = ["01_corporate/1.1.1_a.md", "01_corporate/1.1.2_c.md", "02_financial/2.1.1_b.md", "02_financial/2.1.2_d.md"]
OWNERS = {"01_corporate/1.1.1_a.md": ["CORP-1", "ENV-1"], "01_corporate/1.1.2_c.md": ["COMM-1"], "02_financial/2.1.1_b.md": ["ENV-1", "FIN-1"], "02_financial/2.1.2_d.md": ["COMM-1"]}


def files(spark, texts):
    rows = [(p, "." + p.rsplit(".", 1)[1], p.split("/")[0], p.rsplit("/", 1)[1].split("_")[0], t.encode(), t, True) for p, t in texts.items()]
    return spark.createDataFrame(rows, "rel_path string, suffix string, section string, slot_id string, content binary, text string, valid boolean")


def room(spark, blind=None, flagged=None):
    plain = {p: f"# Heading {p[-4]}\n\n" + "plain prose " * 700 for p in PATHS}
    blind = {**plain, **(blind or {})}
    marked = {p: t + "\n## FLAG\n" + "".join(f"- **{i} (title)** text\n" for i in OWNERS[p]) for p, t in blind.items() if p in OWNERS}
    slots = spark.createDataFrame([(p.rsplit("/", 1)[1].split("_")[0], "A", p) for p in PATHS], "slot_id string, tier string, rel_path string")
    return G.Room(spark, R.room_conf(CONF), files(spark, blind), files(spark, {**marked, **(flagged or {})}), R.findings(spark, FINDINGS), R.distractors(spark, DISTRACTORS), slots=slots)


def status(results):
    return {r["gate"]: r["status"] for r in results.collect()}


def test_the_scorecard_of_four_reports(spark, tmp_path):
    out = tmp_path / "out.json"
    out.write_text(json.dumps({"tool": "t", "room_hash": "", "findings": [{"title": "a", "severity": "critical", "documents": [PATHS[0]], "summary": ""}, {"title": "b", "documents": [PATHS[2]]}, {"title": "c", "documents": [PATHS[1]]}, {"title": "d", "documents": ["02_financial/2.9.9_x.md"]}]}))
    reports = R.tool_reports(spark, str(out))
    assert [r["severity"] for r in reports.orderBy("tool_index").collect()] == ["critical", "medium", "medium", "medium"]
    found, others = R.findings(spark, FINDINGS), R.distractors(spark, DISTRACTORS).select("distractor_id", "location")
    tables = M.score(reports, found, R.evidence(found).select("finding_id", "rel_path"), others)
    m = tables["metrics"].first()
    assert (m["recall"], m["precision"]) == (1.0, 0.75)
    assert [tuple(r) for r in tables["distractors"].collect()] == [("DX-1", "false alarm")]
    assert [tuple(r) for r in tables["partial"].collect()] == [("COMM-1", 1)]
    rulings = R.adjudications(spark, "adjudications:\n- {tool_index: 0, finding_id: null}\n- {tool_index: 2, finding_id: null}\n- {tool_index: 3, finding_id: [FIN-1, CORP-1]}\n")
    tables = M.score(reports, found, R.evidence(found).select("finding_id", "rel_path"), others, rulings)
    assert {tuple(r) for r in tables["misses"].collect()} == {("COMM-1",)}
    assert [tuple(r) for r in tables["distractors"].collect()] == [("DX-1", "citation")]
    assert tables["unadjudicated"].count() == 0
    assert tables["by_severity"].where("severity = 'medium'").first()["found"] == 0


def test_nothing_to_score_gives_zeroes(spark):
    found = R.findings(spark, "findings: []")
    reports = spark.createDataFrame([], "tool_index int, documents array<string>")
    m = M.score(reports, found, R.evidence(found).select("finding_id", "rel_path"), R.distractors(spark, "distractors: []"))["metrics"].first()
    assert (m["recall"], m["precision"]) == (0.0, 0.0)


def test_a_sound_room_passes(spark):
    results = G.run(room(spark))
    assert G.passed(results), results.where("status = 'FAIL'").collect()
    assert status(results)[7] == "PASS" and status(results)[8] == "PASS" and status(results)[11] == "SKIP"
    assert not G.passed(results, strict=True)


@pytest.mark.parametrize(("path", "text", "gate"), [
    (PATHS[0], "the answer key " + "word " * 1300, 4),
    (PATHS[0], "see CORP-12_x " + "word " * 1300, 4),
    (PATHS[1], "see 1.7.77 for more " + "word " * 1300, 9),
    (PATHS[1], "too short", 10),
    (PATHS[1], "TODO " + "word " * 1300, 10),
    (PATHS[2], "from _key/findings " + "word " * 1300, 12),
    (PATHS[2], ("again and " * 20 + "again\n\n") * 60, 21),
    ("03_other/3.1.1_z.md", "word " * 1300, 6),
])
def test_gates_notice_breaks(spark, path, text, gate):
    assert status(G.run(room(spark, {path: text}), {gate: G.GATES[gate]}))[gate] == "FAIL"


def test_numbers_of_no_section_warn_and_clauses_are_spared(spark):
    gate = {9: G.GATES[9]}
    assert status(G.run(room(spark, {PATHS[1]: "see 7.7.77 for more " + "word " * 1300}), gate))[9] == "WARN"
    assert status(G.run(room(spark, {PATHS[1]: "under clause 1.7.77 and 1.7.78 " + "word " * 1300}), gate))[9] == "PASS"


def test_twins_and_carriers_are_held_to_the_key(spark):
    changed = room(spark, flagged={PATHS[3]: "plain\n## FLAG\n- **FIN-1 (title)** text\n"})
    got = status(G.run(changed, {n: G.GATES[n] for n in (7, 8)}))
    assert got == {7: "FAIL", 8: "FAIL"}


def test_a_broken_gate_fails_and_none_is_refused(spark):
    def breaks(_):
        raise KeyError("x")

    assert status(G.run(room(spark), {1: breaks})) == {1: "FAIL"}
    with pytest.raises(ValueError):
        G.run(room(spark), {})


@pytest.mark.parametrize("text", [CONF + 'ROOM_ROLE="x"\n', CONF.replace("exemplar", "other"), CONF.replace('KEY_ROOT="_key"\n', ""), CONF + "no assignment\n", CONF.replace("CORP|FIN", "CORP|CORP")])
def test_bad_configuration_is_refused(text):
    with pytest.raises(R.RoomError):
        R.room_conf(text)


@pytest.mark.parametrize("text", [FINDINGS.replace("critical", "dire"), FINDINGS.replace("FIN-1,", "CORP-1,"), FINDINGS.replace("title: Share issue void, ", ""), "findings: {a: 1}"])
def test_bad_findings_are_refused(spark, text):
    with pytest.raises(R.RoomError):
        R.findings(spark, text)


def test_markdown_reports(spark):
    text = "intro\n## First issue, not low `09/z.md`\nA HIGH risk in `01/a.md` and `02/b.pdf`.\n# Not one\n### Second critical path\nbody `01/a.md` `01/a.md` `no such.md`\n"
    rows = R.markdown_reports(spark.createDataFrame([("r", text)], "rel_path string, text string")).orderBy("tool_index").collect()
    assert [(r["title"], r["severity"], r["documents"]) for r in rows] == [("First issue, not low `09/z.md`", "high", ["01/a.md", "02/b.pdf"]), ("Second critical path", "medium", ["01/a.md", "01/a.md"])]


def test_trees_are_read_with_bad_bytes_replaced(spark, tmp_path):
    (tmp_path / "01_a").mkdir()
    (tmp_path / "01_a" / "1.1.1_x.md").write_bytes(b"ok \xff")
    (tmp_path / "01_a" / ".DS_Store").write_bytes(b"")
    r = R.tree(spark, str(tmp_path)).collect()
    assert [(x["rel_path"], x["section"], x["slot_id"], x["valid"], x["text"]) for x in r] == [("01_a/1.1.1_x.md", "01_a", "1.1.1", False, "ok �")]


def test_figures_of_a_fact_sheet(spark):
    sheet = "# F\n## Canonical figures\n| Key | Value | Superseded |\n|---|---|---|\n| rent | £64.0m | £60m; £61m |\n| area | 700m | – |\n## Other\n| a | b |\n"
    assert [(r["key"], r["value"], r["superseded"]) for r in R.canonical_figures(spark, sheet).collect()] == [("rent", "£64.0m", ["£60m", "£61m"]), ("area", "700m", [])]


def test_form_tells_warns_of_uneven_notes_and_spares_habits(spark):
    text = "plain prose\n\n"
    note = text + "*See the papers at 1.1.2.*\n"
    evidence = ["01_corporate/1.1.1_a.md", "01_corporate/1.1.2_c.md", "01_corporate/1.1.3_e.md"]
    other = [f"01_corporate/1.2.{k}_o.md" for k in range(1, 4)]
    key = FINDINGS.replace("source: 01_corporate/1.1.2_c.md, corroboration: [02_financial/2.1.2_d.md]", "source: 01_corporate/1.1.1_a.md, corroboration: [01_corporate/1.1.2_c.md, 01_corporate/1.1.3_e.md]")

    def gate(noted):
        blind = {p: note if p in noted else text for p in evidence + other}
        return G.form_tells(G.Room(spark, R.room_conf(CONF), files(spark, blind), None, R.findings(spark, key), R.distractors(spark, DISTRACTORS)))

    assert gate(evidence[:1])[0] == G.WARN  # a lone pointer ahead
    assert gate([evidence[0], evidence[2], *other])[0] == G.PASS  # most of the section points there
    said = gate([evidence[2], evidence[0]])
    assert said[0] == G.WARN and "note asymmetry" in said[1]


def test_the_shell_loads_every_file_of_a_room(spark, tmp_path, monkeypatch, capsys):
    from tallyroom import cli

    key = tmp_path / "_key"
    plain = {p: f"# Heading {p[-4]}\n\nThe price is £1,250 of it.\n\n" + "plain prose " * 700 for p in PATHS}
    for tree, mark in (("blind", False), ("flagged", True)):
        for p, t in plain.items():
            at = tmp_path / tree / p
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(t + ("\n## FLAG\n" + "".join(f"- **{i} (title)** text\n" for i in OWNERS[p]) if mark else ""))
    key.mkdir()
    (tmp_path / "room.conf").write_text(CONF)
    (tmp_path / "index.md").write_text("".join(f"- {p.rsplit('/', 1)[1].split('_')[0]} thing\n" for p in PATHS))
    (key / "findings.yaml").write_text(FINDINGS)
    (key / "distractors.yaml").write_text(DISTRACTORS)
    (key / "anchors.csv").write_text("slot_id,tier,rel_path\n" + "".join(f"{p.rsplit('/', 1)[1].split('_')[0]},A,{p}\n" for p in PATHS))
    (key / "fact-sheet.md").write_text("## Canonical figures\n\n| Key | Value | Superseded |\n|---|---|---|\n| price | £1,250 | £1,100; £990 |\n| fee | £77 | — |\n")
    (key / "gaps.yaml").write_text("gaps:\n- {ref: 9.9.9}\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    room = cli._room(spark, str(tmp_path))
    assert room.gaps == ["9.9.9"] and room.verdicts is None and room.subset is None and room.figures.count() == 2
    cli.main(["audit", "--room", str(tmp_path)])
    said = {int(line[5:7]): line[:4].strip() for line in capsys.readouterr().out.splitlines()}
    assert said[1] == "PASS" and said[13] == "FAIL" and said[14] == "SKIP" and said[11] == "SKIP"
    (tmp_path / "report.md").write_text("## Void issue\nHigh, see `01_corporate/1.1.1_a.md`.\n")
    (tmp_path / "empty.md").write_text("nothing to say\n")
    assert cli.main(["score", "--room", str(tmp_path), str(tmp_path / "report.md")]) == 0
    assert cli.main(["score", "--room", str(tmp_path), str(tmp_path / "empty.md")]) == 2


LENGTHS = """words_per_page: 500
bands: {long: {pages: [4, 8], floor: 2000, target: 3000}}
subsections:
- {section: 01_corporate, subsection: a, band: long, paper: target, anatomy: x, hint: h}
- {section: 01_corporate, subsection: b, band: long, paper: counterparty, anatomy: x, hint: h}
"""
ANATOMY = "families: {x: {title: t, parts: [{name: a, share: 60}, {name: b, share: 40}], clauses: [c]}}"


@pytest.mark.parametrize(("old", "new"), [("floor: 2000", "floor: 1999"), ("[4, 8]", "[8, 4]"), ("target: 3000", "target: 2000"), ("target: 3000", "target: 4001"), ("subsection: b", "subsection: a"), ("band: long, paper: target", "band: short, paper: target"), ("paper: target", "paper: mine")])
def test_lengths_are_held_to_their_rules(spark, old, new):
    assert R.lengths(spark, LENGTHS, ANATOMY).count() == 2
    with pytest.raises(R.RoomError):
        R.lengths(spark, LENGTHS.replace(old, new, 1), ANATOMY)
    with pytest.raises(R.RoomError):
        R.lengths(spark, LENGTHS, ANATOMY.replace("40", "41"))


def test_lengths_are_held_to_the_domain(spark):
    sections = R.sections(spark, "sections: [{number: 1, dir_name: 01_corporate, title: t, workstream: w, weight: 1.0, subsections: [a]}]")
    short = spark.createDataFrame([("01_corporate", "a", 2500)], "section string, subsection string, floor int")
    assert sorted(tuple(r) for r in R.length_violations(R.lengths(spark, LENGTHS), sections, short).collect()) == [("01_corporate", "a", "below the floor of a short room"), ("01_corporate", "b", "no such subsection")]


def test_house_forms_of_a_long_room(spark):
    form = "Between [BUYER] and us.\n\nTerm is ten years.\n\nLaw of England."
    paths = [f"01_corporate/1.1_a/1.1.{k}_a-0{k}.md" for k in (1, 2, 3)]
    slots = spark.createDataFrame([(f"1.1.{k}", "A", p, "01_corporate", "a") for k, p in enumerate(paths, 1)], "slot_id string, tier string, rel_path string, section string, subsection string")
    made = room(spark, dict(zip(paths, (form, "Between X and us.\n\nTerm is two years.\n\nLaw of Wales.", form.replace("[BUYER]", "Y")))))
    made.slots, made.lengths = slots, R.lengths(spark, LENGTHS)
    assert status(G.run(made, {22: G.GATES[22]}))[22] == "PASS"  # a short room
    made.conf.values["DOC_LENGTH"] = "long"
    (said,) = G.run(made, {22: G.GATES[22]}).collect()
    assert said["status"] == "FAIL" and said["detail"] == f"{paths[2]} too few deviations"
