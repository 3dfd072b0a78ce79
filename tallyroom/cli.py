"""python -m tallyroom.cli audit | score | manifest | answerkey | classify | names | corrupt | subset | flag | key | import: the engine from a shell.

Exit 0: sound, 1: not, 2: could not be read."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tallyroom.operators import answerkey as K
from tallyroom.operators import candidates
from tallyroom.operators import classify as C
from tallyroom.operators import importer as I
from tallyroom.operators import match as M
from tallyroom.session import session
from tallyroom.sources import lenient, sinks, trees, word
from tallyroom.sources import room as R


def _room(spark, root: str):
    """The room's frames.  Files that need not be there are None (or nothing) where they are not, and their gates are skipped."""
    from tallyroom import gates

    conf = R.room_conf(R.text_of(spark, f"{root}/room.conf"))
    key, blind_root = f"{root}/{conf.get('KEY_ROOT')}".rstrip("/"), f"{root}/{conf.get('BLIND_TREE')}".rstrip("/")
    text = lambda path: R.text_of(spark, path) if R.exists(spark, path) else None
    trees_of = lambda *paths: [R.tree(spark, p) for p in paths if R.exists(spark, p)]
    sheet, checked, gaps = text(f"{key}/fact-sheet.md"), text(f"{key}/name-check.md"), text(f"{key}/gaps.yaml")
    blind = R.tree(spark, blind_root).cache()  # all gates read it
    (flagged,) = trees_of(f"{root}/{conf.get('FLAGGED_TREE')}") or (None,)
    (subset,) = trees_of(f"{root}/subset") or (None,)
    eval_key = expected = None
    if R.exists(spark, f"{key}/answer-key.jsonl") and R.exists(spark, f"{root}/sections.yaml") and R.exists(spark, f"{key}/labels.yaml"):
        eval_key = lenient.key_rows(spark, f"{key}/answer-key.jsonl")
        expected = K.records(_judged(spark, root, conf, blind, None, None))
    fault = lenient.figures_fault(spark.createDataFrame([(sheet,)], "text string")).first()["fault"] if sheet else None
    return gates.Room(
        spark, conf, blind, flagged, R.findings(spark, R.text_of(spark, f"{key}/findings.yaml")), R.distractors(spark, R.text_of(spark, f"{key}/distractors.yaml")),
        index=text(f"{root}/index.md"), slots=R.slots(spark, f"{key}/anchors.csv") if R.exists(spark, f"{key}/anchors.csv") else None,
        figures=R.canonical_figures(spark, sheet) if sheet else None, cast=R.cast_names(spark, sheet) if sheet else None, verdicts=R.name_verdicts(spark, checked) if checked else None,
        subset=subset, eval_key=eval_key, expected_key=expected, figures_fault=fault, lengths=R.lengths(spark, said) if (said := text(f"{root}/lengths.yaml")) else None, gaps=R.gaps(gaps) if gaps else [])


def _report_text(spark, path: str) -> str:
    """A report's text, from markdown or a Word file."""
    if not path.endswith(".docx"):
        return spark.read.format("binaryFile").load(path).select(R.report_text(F.col("content"))).first()[0]
    said = word.word_markdown(word.word_paragraphs(spark.read.format("binaryFile").load(path).select(F.col("path").alias("rel_path"), "content"))).first()
    if said is None or said["error"]:
        raise R.RoomError(f"{path}: {said['error'] if said else 'no such file'}")
    if said["note"]:
        print(f"warning: {said['note']}", file=sys.stderr)
    return said["text"]


def _reports(spark, path: str):
    """A tool's reports from JSON, markdown or a Word file."""
    if not path.endswith(".docx"):
        return R.reports_of(spark, path)
    found = R.markdown_reports(spark.createDataFrame([(path, _report_text(spark, path))], "rel_path string, text string")).drop("rel_path")
    if found.isEmpty():
        raise R.RoomError("no finding in this report: each is a heading of level 2 to 4")
    return found


def _key_path(room: str, conf) -> str:
    return f"{room}/{conf.get('KEY_ROOT')}".rstrip("/")


def _judged(spark, root: str, conf, blind, vocabulary: str | None, domain: str | None):
    """Labels of the room held against its tree, sections and list of types (the room's own, if it has one and none is named)."""
    key = _key_path(root, conf)
    if not R.exists(spark, f"{key}/labels.yaml"):
        raise R.RoomError(f"no labels at {key}/labels.yaml")
    own = f"{key}/classifier-vocab.txt"
    listed = vocabulary or (own if R.exists(spark, own) else None)
    if listed is None and conf.values.get("ROOM_ROLE") == "eval":
        print("warning: no list of document types; labels are not held against one", file=sys.stderr)
    sections = R.sections(spark, R.text_of(spark, domain or f"{root}/sections.yaml"))
    return K.judged(R.documents(blind), R.label_rows(spark, R.text_of(spark, f"{key}/labels.yaml")), sections, R.vocabulary(spark, listed) if listed else None)


def _answerkey(spark, args) -> int:
    """Builds the key, or names what is wrong with it."""
    conf = R.room_conf(R.text_of(spark, f"{args.room}/room.conf"))
    rows = _judged(spark, args.room, conf, R.tree(spark, f"{args.room}/{conf.get('BLIND_TREE')}"), args.vocabulary, args.sections).cache()
    if wrong := K.breaches(rows).orderBy("rule").collect():
        for r in wrong:
            print(f"{r['rule']}: {r['n']} ({r['named']})", file=sys.stderr)
        return 1
    said = K.records(rows)
    trees.sorted_lines(said.select("source_path", K.record_line(F.col("source_path"), F.col("document_type"), F.col("primary_workstream")).alias("line")), f"{_key_path(args.room, conf)}/answer-key.jsonl", "source_path")
    print(f"{said.count()} records")
    return 0


def _classify(spark, args) -> int:
    """Scores a classification; the output must cover the key's documents and come from this room, where it says so."""
    conf = R.room_conf(R.text_of(spark, f"{args.room}/room.conf"))
    path = args.key or f"{_key_path(args.room, conf)}/answer-key.jsonl"
    if not R.exists(spark, path):
        raise R.RoomError(f"no key at {path}: build it with answerkey")
    key, output = lenient.key_rows(spark, path).cache(), lenient.sound(lenient.classified(spark, args.output), args.output).cache()
    manifest = args.manifest or f"{_key_path(args.room, conf)}/manifest.json"
    said = sinks.provenance(sinks.read_hash(R.text_of(spark, manifest)) if R.exists(spark, manifest) else "", R.agreed_hash(output))
    apart = C.coverage(key, output)
    if not apart.isEmpty():
        raise R.RoomError("key and output differ: " + "; ".join(f"{r['side']}: {r['n']} ({r['named']})" for r in K.named(apart, "side", "source_path").orderBy("side").collect()))
    print(sinks.classification_text(C.paired(key, output), args.output.rsplit("/", 1)[-1].rsplit(".", 1)[0], said), end="")
    return 0


def _names(spark, args) -> int:
    conf = R.room_conf(R.text_of(spark, f"{args.room}/room.conf"))
    sheet = spark.createDataFrame([("fact-sheet.md", R.text_of(spark, f"{_key_path(args.room, conf)}/fact-sheet.md"))], "rel_path string, text string")
    bad = 0
    for r in candidates.candidates(sheet).orderBy("name").collect():
        print(f"{r['name']}\t{r['kind']}" + (f"\t{r['fault']}" if r["fault"] else ""))
        bad += bool(r["fault"])
    return 1 if bad else 0


def _import(spark, args) -> int:
    """Turns a reviewer's report into a tool's output, or says why it cannot be scored."""
    conf = R.room_conf(R.text_of(spark, f"{args.room}/room.conf"))
    cut_name = (args.cut or conf.get("BLIND_TREE")).strip("/")
    if not R.exists(spark, f"{args.room}/{cut_name}"):
        raise R.RoomError(f"no folder {cut_name} in the room")
    sections, cut = conf.words("SECTION_DIRS"), R.cut_documents(R.tree(spark, f"{args.room}/{cut_name}")).cache()
    text = _report_text(spark, args.report)
    report = spark.createDataFrame([(args.report, text)], "rel_path string, text string")
    markers = [x for x in (*conf.get("KEY_ROOT").split("/"), conf.get("FLAGGED_TREE").strip("/").split("/")[-1]) if x]
    got = I.imported(report, cut, sections, markers, args.wide)
    wrong = got["refused"].where("rule <> 'not in the cut'" if args.drop_unknown else "true")
    if rows := K.named(wrong, "rule", "path").orderBy("rule").collect():
        raise R.RoomError("; ".join(f"{r['rule']}: {r['n']} ({r['named']})" for r in rows))
    issues = got["issues"].orderBy("tool_index").collect()  # those of one report
    if not issues:
        raise R.RoomError("no issue in this report: each is a heading of level 2 to 4")
    here = {r["rel_path"] for r in cut.join(got["issues"].select(F.explode("documents").alias("rel_path")).distinct(), "rel_path", "left_semi").collect()}
    field = report.select(I.preamble_fields(F.col("text")).alias("f")).first()["f"]
    manifest = f"{_key_path(args.room, conf)}/manifest.json"
    output = {"tool": args.tool or " / ".join(x for x in (field["model"], field["skill"]) if x) or "unknown", "room_hash": sinks.read_hash(R.text_of(spark, manifest)) if R.exists(spark, manifest) else "",
              "findings": [{"title": r["title"], "severity": r["severity"], "documents": [p for p in r["documents"] if p in here], "summary": r["summary"]} for r in issues]}
    trees.text_file(spark, args.out, json.dumps(output, indent=2, ensure_ascii=False) + "\n")
    counts = I.import_counts({**got, "issues": got["issues"].withColumn("documents", F.filter("documents", lambda p: p.isin(*here)) if here else F.array().cast("array<string>"))}, cut).first().asDict()
    dropped = sorted(r["path"] for r in got["refused"].where("rule = 'not in the cut'").select("path").distinct().collect())
    print(sinks.import_text(output, counts, cut_name, not got["read"].isEmpty(), dropped), end="")
    return 0


def _derive(spark, args) -> int:
    """Writes a corrupted, subset or flagged tree to a new folder."""
    conf = R.room_conf(R.text_of(spark, f"{args.room}/room.conf"))
    key, files = _key_path(args.room, conf), R.tree(spark, f"{args.room}/{conf.get('BLIND_TREE')}")
    room = conf.get("ROOM_CODENAME")
    if args.command == "corrupt":
        manifest = f"{key}/manifest.json"
        docs = R.documents(files)
        others = files.join(docs.select("rel_path"), "rel_path", "left_anti")
        told = trees.write_corrupted(docs.select("rel_path", "text"), others, lenient.key_rows(spark, f"{key}/answer-key.jsonl"), args.out, room, args.seed, args.profile, conf.words("SECTION_DIRS"), sinks.read_hash(R.text_of(spark, manifest)) if R.exists(spark, manifest) else "", conf.get("BLIND_TREE").strip("/"))
    elif args.command == "key":
        flagged = R.tree(spark, f"{args.room}/{conf.get('FLAGGED_TREE')}")
        told = trees.write_key(flagged, R.findings(spark, R.text_of(spark, f"{key}/findings.yaml")), R.distractors(spark, R.text_of(spark, f"{key}/distractors.yaml")), args.out, args.room)
    elif args.command == "subset":
        told = trees.write_subset(files, R.findings(spark, R.text_of(spark, f"{key}/findings.yaml")), args.total, args.out, room)
    else:
        told = trees.write_flagged(files, R.findings(spark, R.text_of(spark, f"{key}/findings.yaml")), R.distractors(spark, R.text_of(spark, f"{key}/distractors.yaml")), args.out, conf.get("FLAG_STRING_1"))
    print(", ".join(f"{k} {v}" for k, v in told.items()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyroom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("audit", "score", "manifest", "answerkey", "classify", "names", "corrupt", "subset", "flag", "key", "import"):
        p = commands.add_parser(name)
        p.add_argument("--room", required=True)
        if name == "answerkey":
            p.add_argument("--vocabulary")
            p.add_argument("--sections")
        if name == "classify":
            p.add_argument("output")
            p.add_argument("--key")
            p.add_argument("--manifest")
        if name in ("corrupt", "subset", "flag", "key", "import"):
            p.add_argument("--out", required=True)
        if name == "corrupt":
            p.add_argument("--seed", type=int, required=True)
            p.add_argument("--profile", choices=("light", "heavy"), default="light")
        if name == "import":
            p.add_argument("report")
            p.add_argument("--cut")
            p.add_argument("--tool")
            p.add_argument("--drop-unknown", action="store_true")
            p.add_argument("--wide", action="store_true")
        if name == "subset":
            p.add_argument("--total", type=int, required=True)
        if name == "audit":
            p.add_argument("--strict", action="store_true")
        if name == "score":
            p.add_argument("output")
            p.add_argument("--adjudications")
            p.add_argument("--baseline")
    args = parser.parse_args(argv)
    spark = session()
    try:
        if run := {"answerkey": _answerkey, "classify": _classify, "names": _names, "corrupt": _derive, "subset": _derive, "flag": _derive, "key": _derive, "import": _import}.get(args.command):
            return run(spark, args)
        room = _room(spark, args.room)
        if args.command == "audit":
            from tallyroom import gates

            results = gates.run(room).cache()
            for r in results.orderBy("gate").collect():
                print(f"{r['status']:4} {r['gate']:2} {r['name']}: {r['detail']}")
            print(gates.summary(results, args.strict), file=sys.stderr)  # the lines of gates stay alone
            return 0 if gates.passed(results, args.strict) else 1
        if args.command == "score":
            reports = _reports(spark, args.output)
            ruled = args.adjudications or f"{args.room}/{room.conf.get('KEY_ROOT')}".rstrip("/") + "/adjudications.yaml"
            rulings = R.adjudications(spark, R.text_of(spark, ruled)) if args.adjudications or R.exists(spark, ruled) else None
            if rulings is not None and (bad := R.adjudication_violations(rulings, reports, room.findings).take(1)):
                raise R.RoomError(f"adjudication of {bad[0]['tool_index']}: {bad[0]['rule']}")
            scored = lambda found: M.score(found, room.findings, R.evidence(room.findings).select("finding_id", "rel_path"), room.distractors.select("distractor_id", "location"), rulings)
            manifest = f"{_key_path(args.room, room.conf)}/manifest.json"
            own = sinks.read_hash(R.text_of(spark, manifest)) if R.exists(spark, manifest) else ""
            print(f"provenance: {sinks.provenance(own, R.report_hash(spark, args.output))}")
            tables = scored(reports)
            print(sinks.scorecard_text(tables))
            if args.baseline:
                told = M.scorecard_diff(scored(_reports(spark, args.baseline))["misses"].select("finding_id"), tables["misses"].select("finding_id"))
                print("\n".join(f"{r['change']}: {r['finding_id']}" for r in told.orderBy("change", "finding_id").collect()) or "as the baseline")
            return 0
        print(sinks.manifest(room.blind, room.conf.get("ROOM_CODENAME"), findings=room.findings.count()), end="")
        return 0
    except Exception as error:
        print(str(error).splitlines()[0] if str(error) else type(error).__name__, file=sys.stderr)
        return 2
    finally:
        spark.catalog.clearCache()  # what a command has kept is of no use to the next one of this session


if __name__ == "__main__":
    sys.exit(main())
