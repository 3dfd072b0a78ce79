"""Operators on small literals."""

import difflib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import audit, consolidate, derive, houseforms, importer, order, tells


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("text", "count"), [("", 0), ("one two\nthree", 3), ("日本語 word", 2), ("日本 語 a", 2), ("a b", 2)])
def test_wordcount(spark, text, count):
    assert one(spark, text, T.wordcount) == count


def test_content_words(spark):
    assert set(one(spark, "The Exclusions of class £1,200,000 and glass were waived", T.content_words)) == {"exclusion", "class", "1200000", "glass", "waived"}


@pytest.mark.parametrize(("needle", "text", "found"), [("700m", "3700m", False), ("£64.0m", "was £64.0m.", True), ("64", "64¹", True), ("", "x", False), ("a", "ba a", True), ("x\\E", "an x\\E.", True)])
def test_isolated(spark, needle, text, found):
    assert one(spark, text, lambda t: T.isolated(t, F.lit(needle))) is found


def test_entities(spark):
    text = "See Kessler Werke GmbH and The Helmswick\nGroup Limited, a Private Limited Company. Bath spa; Alpha SpA; Beta incorporated."
    assert one(spark, text, T.entity_tokens) == ["Alpha SpA", "Helmswick Group Limited", "See Kessler Werke GmbH"]
    assert "Kessler" not in one(spark, text, lambda t: T.mask_names(t, ["Kessler Werke GmbH"]))
    candidates = table(spark, [("Imaging Ltd",), ("Other Imaging Limited",), ("Limited",)], "candidate string")
    cast = table(spark, [("Helmswick Imaging Limited",)], "name string")
    assert [r[0] for r in audit.trailing_phrases(candidates, cast).collect()] == ["Imaging Ltd"]


@pytest.mark.parametrize(("text", "date"), [("x\nDated: 3rd May 2021\n", "2021-05-03"), ("1 June 2020\nDate 2 July 2022", "2022-07-02"), ("no date", None), ("31 February 2020", None)])
def test_document_date(spark, text, date):
    got = one(spark, text, T.document_date)
    assert (str(got) if got else None) == date


def test_titles_and_twins(spark):
    assert one(spark, "ndas-and-the-vat-its", T.title_case) == "NDAs and the VAT its"
    assert one(spark, "w-and-i-01", T.title_case) == "W&I 01"
    assert one(spark, "a\n## FLAG\nb\n## FLAG\nc", lambda t: T.twin_body(t, "## FLAG")) == "a\n## FLAG\nb"
    assert one(spark, "none", lambda t: T.twin_body(t, "## FLAG")) is None


def test_repetition(spark):
    block = "word " * 30
    docs = table(spark, [("a", f"{block}\n\n{block}\n\n| {block} |\n\nshort\n\nshort"), ("b", "")], "rel_path string, text string")
    assert {r["rel_path"]: (r["total"], r["repeated"]) for r in audit.repetition(docs, T.paragraphs(F.col("text"))).collect()} == {"a": (62, 30), "b": (0, 0)}


def test_containment_equals_a_scan(spark):
    rng = random.Random(1)
    texts = [(str(i), "".join(rng.choice("ab1 .-") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    needles = sorted({"".join(rng.choice("ab1 .-") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    docs, frame = table(spark, texts, "rel_path string, text string"), table(spark, [(n,) for n in needles], "needle string")
    assert {tuple(r) for r in audit.containment(docs, frame).collect()} == {(i, n) for i, t in texts for n in needles if n in t}
    alone = lambda n, t: any(not (k and t[k - 1].isalnum()) and not (t[k + len(n) :][:1].isalnum()) for k in range(len(t)) if t.startswith(n, k))
    assert {tuple(r) for r in audit.containment(docs, frame, isolated=True).collect()} == {(i, n) for i, t in texts for n in needles if alone(n, t)}


def test_damage_is_the_same_in_any_partitioning(spark):
    docs = table(spark, [(f"0{i % 3}_s/1.1.{i}_doc-{i}.{'csv' if i % 7 == 0 else 'md'}", "\n".join(["Some line of text"] * 40)) for i in range(60)], "rel_path string, text string")
    run = lambda d, exact: sorted(map(tuple, derive.damaged(d, 3, "heavy", ["00_s", "01_s", "02_s"], exact).collect()))
    once = run(docs.coalesce(1), True)
    assert once == run(docs.repartition(7), True) and len({r[1] for r in once}) == 60
    assert any(r[3] for r in once) and any(r[5] for r in once) and all(r[2].count("\n") == 39 for r in once if r[0].endswith("csv"))
    assert len(run(docs, False)) == 60


def test_hashed_noise_of_odd_texts(spark):
    """Against one hash after another; beyond Latin letters, without any that can be confused, and longer than what is hashed at once."""
    rows = [("p", "lost to all"), ("q", "Ωl\u0000é😀l1o\n" * 40), ("r", "xyz"), ("s", ""), ("t", None), (None, "late oil"), ("a/" * 60, "Bat 5" * 40), ("u", "o" * (derive.HASHED + 9))]

    def plain(p, t, bp):
        told = lambda i: int(hashlib.sha256("|".join(["3", *([p] if p is not None else []), "noise", str(i)]).encode()).hexdigest()[:16], 16) % 10000 < bp
        return t and "".join(derive.CONFUSIONS[c] if c in derive.CONFUSIONS and told(i) else c for i, c in enumerate(t))

    df = table(spark, rows, "p string, t string")
    for bp in (0, 2000, 10000):
        found = df.select("p", derive.noise_hashed(3, F.col("p"), F.col("t"), bp).alias("t"))
        assert {tuple(r) for r in found.collect()} == {(p, plain(p, t, bp)) for p, t in rows}
    assert "sha2" not in found._jdf.queryExecution().executedPlan().toString()  # no interpreted hash a character


def test_names_that_meet_generated_names(spark):
    named = table(spark, [("1", "f", ".md", "a"), ("2", "f", ".md", "a"), ("3", "f", ".md", "a (2)"), ("4", "g", ".md", "a")], "rel_path string, folder string, suffix string, stem string")
    out = [r["final"] for r in derive.unique_names(named).orderBy("rel_path").collect()]
    assert out[0] == "a" and out[3] == "a" and len(set(out[:3])) == 3




def test_containment_without_a_scan(spark):
    """Needles of every kind against plain search: inside words, across them, marks only, at both ends of a text."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "abc", "x1", " ", "-", "##", ". ", "\n", "Ω", "[T]"]) for _ in range(rng.randrange(25))) for _ in range(150)]
    needles = ["ab", "b", "abc", "1", "##", "-", "b-a", "b ab", "[T]", "Ω", "x1. ab", ". ", "zz", "ab##", "ababab", "[", " ", "bx1"]
    docs = table(spark, [(str(i), t) for i, t in enumerate(texts)], "rel_path string, text string")
    found = audit.containment(docs, table(spark, [(n,) for n in needles], "needle string"))
    assert {tuple(r) for r in found.collect()} == {(str(i), n) for i, t in enumerate(texts) for n in needles if n in t}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    alone = audit.containment(docs, table(spark, [(n,) for n in needles], "needle string"), isolated=True)
    free = lambda t, n: any(not (k and t[k - 1].isalnum()) and not (k + len(n) < len(t) and t[k + len(n)].isalnum()) for k in range(len(t)) if t.startswith(n, k))
    assert {tuple(r) for r in alone.collect()} == {(str(i), n) for i, t in enumerate(texts) for n in needles if free(t, n)}


def test_batches(spark):
    rows = table(spark, [("g", i, w) for i, w in enumerate([5, 5, 20, 1, 1, 9])], "g string, i int, w int")
    assert [r["batch"] for r in order.budget_batches(rows, ["g"], "i", "i", "w", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3]
    assert order.budget_batches(rows, ["g"], "i", "i", "w", 10, 2).count() == 3


def test_a_wave_consolidated_twice_allocates_once(spark):
    registry = table(spark, [("A-1", "t", None, None), ("A-7", "u", None, None)], "finding_id string, title string, discoverable_from_blind boolean, audit_note string")
    said = table(spark, [("A-1", None, True, "ok"), ("A-9", None, True, "x"), ("A-7", "other", None, None)], registry.schema.simpleString()[7:-1].replace(":", " "))
    new = table(spark, [("w1", "w1-NEW-2", "corp", "n2"), ("w1", "w1-NEW-1", "corp", "n1"), ("w1", "w1-NEW-3", "none", "n3")], "label string, provisional_id string, workstream string, title string")
    empty, prefixes = table(spark, [], "provisional_id string, finding_id string"), table(spark, [("corp", "A")], "workstream string, prefix string")
    first = consolidate.wave(registry, said, new, empty, prefixes)
    assert {tuple(r) for r in first["ledger"].collect()} == {("w1-NEW-1", "A-8"), ("w1-NEW-2", "A-9")}
    assert {tuple(r) for r in first["violations"].collect()} == {("A-9", "unknown id"), ("A-7", "changes title"), ("w1-NEW-3", "no prefix")}
    assert first["registry"].where("finding_id = 'A-1'").first()["discoverable_from_blind"] is True
    again = consolidate.wave(first["registry"], said, new, first["ledger"], prefixes)
    assert again["added"].count() == 0 and again["ledger"].count() == 2


def test_form_tells(spark):
    text = "# T\n- **exclusion clause waived liability** here\n- plain item\n- another\n\n```\n- **in code**\n```\n| h | k |\n|---|---|\n| **x** | y |\n| Total | 1 |\n\n*See 2.2.2\nand 1.1.1.*\n"
    docs = table(spark, [("01/1.1.1_a.md", text)], "rel_path string, text string")
    found = tells.items(docs)
    assert [(r["line"], r["kind"]) for r in found.where("kind <> 'line'").orderBy("line").collect()] == [(2, "item"), (3, "item"), (4, "item"), (11, "row")]
    roles = table(spark, [("01/1.1.1_a.md", "F-1", ["exclusion", "clause", "waived"])], "rel_path string, owner string, words array<string>")
    assert [(r["line"], r["owner"], r["shared"]) for r in tells.selective_bold(found, roles).collect()] == [(2, "F-1", 3)]
    assert [r["slot_id"] for r in tells.italic_notes(docs).collect()] == ["2.2.2"]


def test_import_of_a_report(spark):
    text = "## First\nhigh: `x/room/01_a/d.pdf` and 01_a/e.md\n## Files read\n01_a/f.md\n## Second\n`_key/01_a/k.md`\n"
    cut = table(spark, [("01_a/d.md",), ("01_a/f.md",), ("01_a/g.md",)], "rel_path string")
    out = importer.imported(table(spark, [("r", text)], "rel_path string, text string"), cut, ["01_a"])
    issues = out["issues"].orderBy("tool_index").collect()
    assert [(r["title"], r["documents"]) for r in issues] == [("First", ["01_a/d.md", "01_a/e.md"]), ("Second", ["01_a/k.md"])]
    assert {(r["path"], r["rule"]) for r in out["refused"].collect()} == {("01_a/e.md", "not in the cut"), ("01_a/k.md", "not in the cut"), ("_key/01_a/k.md", "on the key's side")}
    assert [r["path"] for r in out["read"].collect()] == ["01_a/f.md"]
    assert {r["path"] for r in out["uncited"].collect()} == {"01_a/f.md", "01_a/g.md"}


def test_house_forms(spark):
    form = "Between [BUYER] and us.\n\nTerm is [TERM].\n\nLaw of England."
    pairs = table(spark, [("a", form, form), ("b", form, "Between X and us.\n\nTerm is 2 years.\n\nLaw of England."), ("c", form, "Between X and us.\n\nEnds never.\n\nLaw of Wales.\n\nMore.")], "rel_path string, house_text string, text string")
    assert sorted(map(tuple, houseforms.problems(pairs).collect())) == [("a", "blanks left"), ("a", "too few deviations"), ("b", "too few deviations")]


def plain_deviations(form, own):
    """By the standard library's alignment, which takes the longest common run first."""
    split = lambda t: [" ".join(p.split()) for p in re.split(r"\n[ \t\r]*\n", t) if p.strip()]
    a, b, n = split(form), split(own), 0
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            n += sum(not re.search(r"\[[A-Z][^\[\]\n]{0,80}\]", p) for p in a[i:j]) + max(0, (m - k) - (j - i))
    return n


def test_deviations_against_plain_alignment(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        form = [rng.choice(("Clause " + rng.choice("abcd"), f"Own {rng.randrange(30)}", f"To [FILL {rng.randrange(3)}]")) for _ in range(rng.randrange(14))]
        own = [x if rng.random() < 0.7 else rng.choice(("Clause " + rng.choice("abcd"), "New", "")) for x in form]
        if rng.random() < 0.5:
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choices(form or ["x"], k=rng.randrange(3))
        rows.append((f"p{k}", "\n\n".join(form), rng.choice(("\n\n", "\r\n \r\n")).join(own)))
    rows += [("same", "A\n\nB", "A\n\nB"), ("none", "", "A"), ("gone", "A\n\nB", "")]
    found = {r["rel_path"]: r["n"] for r in houseforms.deviations(table(spark, rows, "rel_path string, house_text string, text string").repartition(3)).collect()}
    assert found == {p: plain_deviations(a, b) for p, a, b in rows}
    assert houseforms.deviations(table(spark, [], "rel_path string, house_text string, text string")).count() == 0


def test_deviations_of_texts_with_many_blocks(spark):
    """A text of three hundred blocks is not three hundred rounds over the table: no job runs before the result is asked for."""
    form = [f"Clause {i}" for i in range(901)]
    own = [x for i, x in enumerate(form) if i % 3]
    rows = [("a", "\n\n".join(form), "\n\n".join(own)), ("b", "\n\n".join(form), "\n\n".join(own + ["New"])), ("b", "A", "B\n\nC")]
    context = spark.sparkContext
    context.setJobGroup("deviations", "planned")
    found = houseforms.deviations(table(spark, rows, "rel_path string, house_text string, text string"))
    assert not context.statusTracker().getJobIdsForGroup("deviations")
    assert sorted(map(tuple, found.collect())) == [("a", plain_deviations(*rows[0][1:])), ("b", 2), ("b", plain_deviations(*rows[1][1:]))]
    context.setLocalProperty("spark.jobGroup.id", None)


def test_a_room_of_house_forms(spark):
    form = "Between [BUYER] and us.\n\nTerm is ten years.\n\nLaw of England."
    good = "Between X and us.\n\nTerm is two years.\n\nLaw of Wales."
    slots = table(spark, [(f"1/1.1_a/1.1.{k}_a.md", "1", "a", k) for k in (10, 2, 3, 4)] + [(f"1/1.2_b/1.2.{k}_b.md", "1", "b", k) for k in (1, 2)] + [(f"1/1.3_c/1.3.{k}_c.md", "1", "c", k) for k in (1, 2, 3)], "rel_path string, section string, subsection string, ordinal int")
    lengths = table(spark, [("1", "a", "target"), ("1", "b", "target"), ("1", "c", "counterparty")], "section string, subsection string, paper string")
    family = houseforms.families(slots, lengths)
    assert {r["rel_path"]: r["house"] for r in family.collect()} == {f"1/1.1_a/1.1.{k}_a.md": "1/1.1_a/1.1.2_a.md" for k in (10, 2, 3, 4)}
    docs = {2: form, 3: good, 4: form.replace("[BUYER]", "X"), 10: good.replace("Between X", "Between [BUYER]")}
    texts = table(spark, [(f"1/1.1_a/1.1.{k}_a.md", t) for k, t in docs.items()], "rel_path string, text string")
    none = table(spark, [], "rel_path string")
    assert sorted((r[0].split("/")[-1], r[1]) for r in houseforms.form_problems(family, texts, none).collect()) == [("1.1.10_a.md", "blanks left"), ("1.1.4_a.md", "too few deviations")]
    bare = texts.where("rel_path NOT LIKE '%1.1.2_a.md'").union(table(spark, [("1/1.1_a/1.1.2_a.md", good)], "rel_path string, text string"))
    marked = table(spark, [("1/1.1_a/1.1.2_a.md",), ("1/1.1_a/1.1.3_a.md",)], "rel_path string")
    found = sorted((r[0].split("/")[-1], r[1]) for r in houseforms.form_problems(family, bare, marked).collect())
    assert ("1.1.2_a.md", "evidence on a house form") in found and ("1.1.2_a.md", "no blanks") in found and not any(p.startswith("1.1.3") and q.startswith("evidence") for p, q in found)


def test_names_count_up_as_one_after_another(spark):
    """Held against counting up from 2 in order until a name is free."""

    rng, stems = random.Random(3), ["a", "a (2)", "a (3)", "a (2) (2)", "b", "b", "c (x)", "(2)"]
    rows = [(f"p{i:04d}", rng.choice("xy"), ".md", rng.choice(stems)) for i in range(300)] + [("q1", "z", ".md", "a (2)"), ("q2", "z", ".md", "a"), ("q3", "z", ".md", "a")]
    taken, want = set(), {}
    for path, folder, suffix, stem in sorted(rows):
        name, n = stem, 2
        while (folder, suffix, name) in taken:
            name, n = f"{stem} ({n})", n + 1
        taken.add((folder, suffix, name))
        want[path] = name
    df = spark.createDataFrame(rows, "rel_path string, folder string, suffix string, stem string")
    assert {r["rel_path"]: r["final"] for r in derive.unique_names(df).collect()} == want and want["q3"] == "a (3)"


def test_titles_join_the_words_w_and_i_only(spark):

    slugs = {"w-and-i-01": "W&I 01", "law-and-insurance": "Law and insurance", "vat ndas its": "VAT NDAs its", "terms-w-and-i": "Terms W&I", "w-and-it": "W and IT"}
    df = spark.createDataFrame([(k,) for k in slugs], "slug string")
    assert {r[0]: r[1] for r in df.select("slug", T.title_case(F.col("slug"))).collect()} == slugs


def test_other_files_are_copied_as_they_are(spark):
    docs = spark.createDataFrame([(f"s{i % 3}/d{i}.{x}", "one two three " * 20) for i in range(80) for x in ("md", "csv", "png")], "rel_path string, text string")
    rows = derive.damaged(docs, 7, "heavy", ["s0", "s1", "s2"]).collect()
    other = [r for r in rows if r["rel_path"].endswith(".png")]
    assert len(rows) == 240 and all(r["new_path"] == r["rel_path"] and not (r["rename"] or r["misfile"] or r["noise"] or r["truncate"]) for r in other)
    assert any(r["misfile"] for r in rows) and not any(r["noise"] for r in rows if r["rel_path"].endswith(".csv"))
