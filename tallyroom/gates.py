"""The gates of an audit.  Each is a function of a room's frames and gives one (gate, name, status, detail) row; a gate
that fails to run is a FAIL.  Documents are scanned once and kept for all gates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import audit as A
from tallyroom.operators import candidates as N
from tallyroom.operators import houseforms as H
from tallyroom.operators import match as M
from tallyroom.operators import tells as E
from tallyroom.sources import room as R

PASS, FAIL, SKIP, WARN = "PASS", "FAIL", "SKIP", "WARN"

#: Words of answer keys and of a room's making.
KEY_NOUNS = ("planted finding", "distractor", "answer key", "red herring", "diligence flag", "ground truth")
MAKING_WORDS = ("blind room", "blind tree", "flagged room", "flagged tree", "renumber", "data-room", "_key", "tier a", "tier f")


@dataclass
class Room:
    """What gates look at; a frame that is None is not there."""

    spark: SparkSession
    conf: R.RoomConf
    blind: DataFrame
    flagged: DataFrame | None
    findings: DataFrame
    distractors: DataFrame
    index: str | None = None
    slots: DataFrame | None = None
    figures: DataFrame | None = None
    verdicts: DataFrame | None = None
    cast: DataFrame | None = None
    subset: DataFrame | None = None
    renders: DataFrame | None = None
    eval_key: DataFrame | None = None
    expected_key: DataFrame | None = None
    figures_fault: str | None = None
    lengths: DataFrame | None = None
    patterns: DataFrame | None = None
    gaps: list[str] = field(default_factory=list)
    floors: dict[str, int] = field(default_factory=lambda: {"A": 1200, "F": 350})

    def marker(self) -> str:
        return self.conf.get("FLAG_STRING_1")


Verdict = tuple[str, str]


def shown(rows: list[str], limit: int = 5, total: int | None = None) -> str:
    """The first few, and how many more there are in all."""
    more = (len(rows) if total is None else total) - limit
    return ", ".join(rows[:limit]) + (f" (+{more} more)" if more > 0 else "")


def _listed(df: DataFrame, status: str = FAIL, none: str = "clean") -> Verdict:
    rows = [" ".join(str(x) for x in r) for r in df.orderBy(*df.columns).limit(6).collect()]  # what is shown, and whether there is more
    return (status, shown(rows, total=df.count() if len(rows) > 5 else None)) if rows else (PASS, none)


def _evidence(room: Room) -> DataFrame:
    return R.evidence(room.findings).select("finding_id", "rel_path")


def index_counts(room: Room) -> Verdict:
    if room.index is None:
        return SKIP, "no index"
    n = len(re.findall(r"(?m)^\s*[-*|]?\s*\d{1,2}\.\d{1,2}\.\d{1,3}\b", room.index))
    return (PASS, f"{n} slots") if n == room.conf.number("INDEX_TOTAL") else (FAIL, f"{n} slots, {room.conf.get('INDEX_TOTAL')} declared")


def tree_counts(room: Room) -> Verdict:
    blind = R.documents(room.blind).count()
    flagged = None if room.flagged is None else R.documents(room.flagged).count()
    bad = [f"{n} in {t}" for t, n, want in (("blind", blind, room.conf.number("BLIND_TOTAL")), ("flagged", flagged, room.conf.number("FLAGGED_TOTAL"))) if n is not None and n != want]
    return (FAIL, shown(bad)) if bad else (PASS, f"{blind} documents")


def _sweep(room: Room, needles, pattern: str | None = None) -> Verdict:
    return _listed(A.literal_sweep(room.blind.select("rel_path", "text"), list(needles), pattern))


def flag_strings(room: Room) -> Verdict:
    return _sweep(room, (room.conf.get("FLAG_STRING_1"), room.conf.get("FLAG_STRING_2")))


def key_nouns(room: Room) -> Verdict:
    return _sweep(room, KEY_NOUNS, T.finding_id_pattern(room.conf.words("FINDING_PREFIXES")))


def index_words(room: Room) -> Verdict:
    if room.index is None:
        return SKIP, "no index"
    found = [w for w in (*KEY_NOUNS, *MAKING_WORDS) if w in room.index.lower()]
    return (FAIL, shown(found)) if found else (PASS, "clean")


def directories(room: Room) -> Verdict:
    want = room.spark.createDataFrame([(x,) for x in room.conf.words("SECTION_DIRS")], "section string")
    return _listed(A.both_ways(room.blind.select("section"), want, "section"))


def twins(room: Room) -> Verdict:
    if room.flagged is None:
        return SKIP, "no flagged tree"
    return _listed(A.twin_diff(R.documents(room.blind).select("rel_path", "text"), room.flagged.select("rel_path", "text"), room.marker()))


def carriers(room: Room) -> Verdict:
    if room.flagged is None:
        return SKIP, "no flagged tree"
    block = F.regexp_extract("text", rf"(?s)\n\Q{room.marker()}\E\n((?:(?!\n\Q{room.marker()}\E\n).)*)$", 1)
    actual = room.flagged.select("rel_path", F.explode(T.claimed_ids(block)).alias("finding_id"))
    lost = _evidence(room).join(room.blind.select("rel_path"), "rel_path", "left_anti")
    if not lost.isEmpty():
        return _listed(lost)
    return _listed(A.carrier_census(_evidence(room), actual).withColumn("finding_ids", F.array_join("finding_ids", ",")))


def references(room: Room) -> Verdict:
    if room.slots is None:
        return SKIP, "no slots"
    numbers = [(int(x.split("_")[0]),) for x in room.conf.words("SECTION_DIRS") if x.split("_")[0].isdigit()]
    found = A.checked_references(room.blind.where("suffix = '.md'").select("rel_path", "text"), room.slots, room.spark.createDataFrame(numbers, "number int"), room.gaps).cache()
    dangling, other = (found.where(F.col("problem") == p).select("rel_path", "ref") for p in ("dangling", "out of range"))
    if dangling.isEmpty():
        return _listed(other, WARN)
    more = _listed(other)
    status, detail = _listed(dangling)
    return status, detail + (f"; out of range: {more[1]}" if more[0] == FAIL else "")


def _long(room: Room) -> bool:
    return room.conf.values.get("DOC_LENGTH", "short") == "long"


def depth(room: Room) -> Verdict:
    if room.slots is None:
        return SKIP, "no slots"
    if room.patterns is not None:  # floors by archetype, and by band in a long room
        kinds = A.archetypes(room.slots, room.patterns, "")
        each = A.floors(room.slots, kinds, room.patterns.select("archetype", "floor").distinct(), room.floors["F"], room.lengths if _long(room) else None)
        docs = room.blind.where("suffix = '.md'").select("rel_path", "text").join(each, "rel_path", "left")
        bad = A.depth_lint(docs.where("floor IS NOT NULL"), F.col("floor")).where("problem IS NOT NULL").select("rel_path", "problem")
        return _listed(bad.union(docs.where("floor IS NULL").select("rel_path", F.lit("no slot"))))
    docs = room.blind.where("suffix = '.md'").select("rel_path", "slot_id", "text").join(room.slots.select("slot_id", "tier"), "slot_id", "left")
    floor = F.when(F.col("tier") == "A", room.floors["A"]).otherwise(room.floors["F"])
    bad = A.depth_lint(docs.where("tier IS NOT NULL"), floor).where("problem IS NOT NULL").select("rel_path", "problem")
    return _listed(bad.union(docs.where("tier IS NULL").select("rel_path", F.lit("no slot"))))


def subset(room: Room) -> Verdict:
    if room.subset is None:
        return SKIP, "not built"
    return _listed(M.subset_coverage(room.findings, _evidence(room), room.subset).where("NOT covered").select("finding_id"))


def key_root(room: Room) -> Verdict:
    return _sweep(room, (room.conf.get("KEY_ROOT").rstrip("/") + "/",))


def figures(room: Room) -> Verdict:
    if room.figures is None or room.figures.isEmpty():
        return SKIP, room.figures_fault or "no figures"
    if not (bad := A.contradictions(room.figures)).isEmpty():
        return _listed(bad.select("key", F.lit("contradicts itself: mend the fact sheet"), "old"))
    docs = room.blind.select("rel_path", "text")
    current = room.figures.select("key", F.col("value").alias("needle"))
    old = room.figures.select("key", F.explode("superseded").alias("needle"))
    found = A.containment(docs, current.select("needle").union(old.select("needle")).distinct(), isolated=True).select("needle").distinct()
    missing = current.join(found, "needle", "left_anti").select("key", F.lit("is missing"))
    stale = old.join(current.select("needle"), "needle", "left_anti").join(found, "needle", "left_semi").select("key", F.lit("is still superseded"))
    return _listed(missing.union(stale))


def names(room: Room) -> Verdict:
    if room.verdicts is None:
        return SKIP, "no name check"
    known = [r[0] for r in room.cast.select("name").collect()] if room.cast is not None else []
    seen = room.blind.select(F.explode(T.entity_tokens(T.mask_names(F.col("text"), known))).alias("candidate")).distinct()
    if room.cast is not None and not (bad := room.cast.where("kind = 'entity'").where(N.malformed(F.col("name"))).select("name", F.lit("would mask every name that ends so"))).isEmpty():
        return _listed(bad)
    checked = room.verdicts.select(F.col("name").alias("candidate"))
    loose = seen.join(checked, "candidate", "left_anti")
    if known:
        loose = loose.join(A.trailing_phrases(loose, room.cast), "candidate", "left_anti")
    if not loose.isEmpty():
        return _listed(loose)
    if not (hit := room.verdicts.where("verdict = 'collision'").select("name")).isEmpty():
        return _listed(hit)
    return _listed(room.verdicts.where("verdict <> 'clear'").select("name"), WARN)


def discoverable(room: Room) -> Verdict:
    bad = room.findings.where("discoverable_from_blind IS NULL OR NOT discoverable_from_blind").select("finding_id", F.when(F.col("discoverable_from_blind").isNull(), "not audited").otherwise("not reachable"))
    return (SKIP, "no findings") if room.findings.isEmpty() else _listed(bad)


def renders(room: Room) -> Verdict:
    if room.renders is None:
        return SKIP, "no render tree"
    stem = lambda df: df.select(F.regexp_replace("rel_path", r"\.[^./]*$", "").alias("stem"))
    return _listed(A.both_ways(stem(room.blind.where("suffix = '.md'")), stem(room.renders), "stem"))


def key_rules(room: Room) -> Verdict:
    return (SKIP, "empty key") if room.findings.isEmpty() else _listed(A.key_violations(room.findings, room.distractors))


def role(room: Room) -> Verdict:
    said = room.conf.values.get("ROOM_ROLE")
    return (PASS, said) if said else (FAIL, "ROOM_ROLE is not set")


def eval_key(room: Room) -> Verdict:
    said = room.conf.values.get("ROOM_ROLE")
    if said != "eval":
        return (SKIP, "no role") if not said else (PASS, said)
    if room.eval_key is None or room.expected_key is None:
        return FAIL, "no key"
    on_disk = room.eval_key.drop("line")
    state = A.stale_rows(room.expected_key, on_disk.select(room.expected_key.columns), "source_path")
    if "line" in room.eval_key.columns:
        state = state.union(A.moved_rows(room.expected_key, room.eval_key, "source_path", "line").select("source_path", F.lit("out of order")))
    return _listed(state)


def form_tells(room: Room) -> Verdict:
    roles = E.evidence_roles(room.findings, room.distractors)
    every = room.blind.where("suffix = '.md'").select("rel_path", "section", "text")
    docs = every.join(roles.select("rel_path").distinct(), "rel_path", "left_semi")
    if docs.isEmpty():
        return SKIP, "no evidence"
    words = room.findings.select(F.col("finding_id").alias("owner"), T.content_words(F.concat_ws(" ", "title", "substance")).alias("words")).union(room.distractors.select("distractor_id", T.content_words(F.col("title"))))
    bold = E.selective_bold(E.items(docs), roles.join(words, "owner").select("rel_path", "owner", "words")).select("rel_path", "line", "owner")
    paths = room.blind.select("slot_id", "rel_path")
    notes = E.italic_notes(every).join(paths.select("slot_id").distinct(), "slot_id", "left_semi")
    sections = every.select("section", "rel_path")
    cites = notes.join(sections, "rel_path").join(paths.select("slot_id", F.col("rel_path").alias("target")), "slot_id")
    habits = E.section_habits(cites.select("section", "rel_path", "target"), sections)
    dates = docs.select("rel_path", T.document_date(F.col("text")).alias("date"))
    ahead = E.pointers(notes, roles, paths, dates).where("direction = 'forward'").join(sections, "rel_path")
    ahead = ahead.join(habits, ["section", "target"], "left_anti").select("rel_path", "line", "owner")
    noted = sections.join(roles.select("rel_path").distinct().withColumn("is_evidence", F.lit(True)), "rel_path", "left").join(notes.select("rel_path").distinct().withColumn("has_note", F.lit(True)), "rel_path", "left")
    uneven = E.note_asymmetry(noted.select("section", F.coalesce("is_evidence", F.lit(False)).alias("is_evidence"), F.coalesce("has_note", F.lit(False)).alias("has_note")))
    return _listed(bold.union(ahead).union(uneven.select("section", F.lit(0), F.lit("note asymmetry"))), WARN)


def repetition(room: Room) -> Verdict:
    docs = room.blind.where("suffix = '.md'").select("rel_path", "text").where(T.wordcount(F.col("text")) >= 2000)
    bad = A.repetition(docs, T.paragraphs(F.col("text"))).where(F.col("repeated") > 0.1 * F.col("total")).select("rel_path")
    return _listed(bad)


def house_forms(room: Room) -> Verdict:
    if not _long(room):
        return PASS, "short room"
    if room.slots is None or room.lengths is None:
        return SKIP, "no slots or no lengths"
    number = F.split_part("slot_id", F.lit("."), F.lit(3)).cast("int")
    family = H.families(room.slots.withColumn("ordinal", number), room.lengths).cache()
    if family.isEmpty():
        return PASS, "no subfolder of the target's own papers has three slots"
    ends = room.distractors.select(F.col("location").alias("rel_path")).union(room.distractors.select("resolution"))
    return _listed(H.form_problems(family, room.blind.select("rel_path", "text"), _evidence(room).select("rel_path").union(ends)))


GATES: dict[int, Callable[[Room], Verdict]] = dict(enumerate((index_counts, tree_counts, flag_strings, key_nouns, index_words, directories, twins, carriers, references, depth, subset, key_root, figures, names, discoverable, renders, key_rules, role, eval_key, form_tells, repetition, house_forms), 1))


def run(room: Room, gates: dict[int, Callable[[Room], Verdict]] | None = None) -> DataFrame:
    """gate, name, status, detail of every gate."""
    gates = GATES if gates is None else gates
    if not gates:
        raise ValueError("there are no gates")
    empty = room.blind.isEmpty()
    rows = []
    for n, gate in gates.items():
        try:
            status, detail = (SKIP, "the tree is empty") if empty and gate not in (role, eval_key, key_rules) else gate(room)
        except Exception as error:  # a gate that breaks has not passed
            status, detail = FAIL, f"{type(error).__name__}: {(str(error).splitlines() or [''])[0]}"
        rows.append((n, gate.__name__, status, detail))
    return room.spark.createDataFrame(rows, "gate int, name string, status string, detail string")


def summary(results: DataFrame, strict: bool = False) -> str:
    """How many gates ran, failed, were skipped and warned; where most were skipped, that nothing is verified."""
    n = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}
    total, failed, skipped = sum(n.values()), n.get(FAIL, 0), n.get(SKIP, 0)
    out = f"{total} gates run, {failed} failed, {skipped} skipped, {n.get(WARN, 0)} warned"
    if not failed and not skipped:
        out += "; no hard failures"
    elif not failed and 2 * skipped > total:
        out += f"; MOST GATES SKIPPED ({skipped}/{total}): this does not verify the room"
    return out + ("; skipped gates count as failures" if strict and skipped else "")


def passed(results: DataFrame, strict: bool = False) -> bool:
    """No FAIL; with ``strict`` no SKIP either."""
    return results.where(F.col("status").isin(*([FAIL, SKIP] if strict else [FAIL]))).isEmpty()
