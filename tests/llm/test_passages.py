"""Decontamination, substring dedup and near duplicates against brute force."""

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from tallyroom.llm import decontamination, near_duplicates, repeated_phrases
from tallyroom.llm.tables import counted

from .conftest import SCHEMA, odd_texts, words

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, 2, 3) for i, t in rows], SCHEMA).repartition(3)


def shared_texts(seed, width=50):
    """Documents that share passages in whole, in part, at their ends, several times, and by exact copy."""
    rng = random.Random(seed)
    passages = [words(rng, rng.choice((width - 1, width, width + 7, 3 * width))) for _ in range(5)]
    out = list(odd_texts())
    for i in range(100, 150):
        body = words(rng, rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = p[rng.randrange(0, 10) : len(p) - rng.randrange(0, 10)]
            at = rng.randrange(len(body) + 1)
            body = body[:at] + cut + body[at:]
        out.append((i, rng.choice((" ", "\n", "  ")).join(body)))
    out += [(200 + k, out[-k - 1][1]) for k in range(6)]
    return out


def test_decontamination(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    rows = shared_texts(2)
    items = [(1, "one"), (2, None), (3, "!!"), (4, "the the the"), (4, "the the the"), (None, " ".join(words(rng, 12)))]
    items += [(10 + k, " ".join((rows[20 + k][1] or "").split()[5:30])) for k in range(8)] + [(30, (rows[25][1] or "").upper()), (31, "x" * 20_000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def cut(text):
        return ALNUM.findall((text or "").translate(LOWER))

    windows = []
    for i, t in items:
        w = cut(t)
        size = min(10, len(w))
        windows += [("" if i is None else str(i), tuple(w[k : k + size])) for k in range(max(1, len(w) - 9)) if size]

    def expected(text):
        w, hit, named = cut(text), set(), set()
        for name, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    named.add(name)
        return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)

    rows = [r for r in rows if len(r[1] or "") < 50_000]
    want = sorted(((i, *expected(t)) for i, t in rows), key=str)
    for bits in ((23, 24), (6, 6)):  # filters that say no, and filters that are full
        monkeypatch.setattr(decontamination, "WORD_BITS", bits[0])
        monkeypatch.setattr(decontamination, "WINDOW_BITS", bits[1])
        got = decontamination.decontaminate(documents(spark, rows), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r[2] for r in want) and decontamination.decontaminate(none, benchmark).count() == 0
    assert decontamination.decontaminate(odd, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(odd, benchmark, carry=True).select("row.*").columns == odd.columns


def test_decontamination_of_one_word_over_and_over(spark):
    """Thousands of items and a document of one common word, and windows that all lead with it: no product of the two."""
    rng = random.Random(6)
    items = [(k, "the " * (10 + k % 3)) for k in range(3_000)] + [(10_000 + k, " ".join(rng.choice(("the", "and")) for _ in range(30))) for k in range(3_000)]
    docs = [(1, "the " * 20_000), (2, "the " * 9), (3, " ".join(rng.choice(("the", "and")) for _ in range(20_000))), (4, items[-1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in decontamination.decontaminate(documents(spark, docs), benchmark).collect()}
    assert time.time() - began < 60
    spans = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 9):
            spans.setdefault(" ".join(w[k : k + 10]), set()).add(str(i))
    for i, t in docs:
        w = t.split()
        at = [k for k in range(len(w) - 9) if " ".join(w[k : k + 10]) in spans]
        assert got[i]["n_hit"] == len({x for k in at for x in range(k, k + 10)})
        assert set(got[i]["items"]) == {x for k in set(" ".join(w[k : k + 10]) for k in at) for x in spans[k]}


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup(spark, none, seed):
    rows = shared_texts(seed)
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    big = 1 << 63
    for i, w in split:
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, big), big if i is None else i)
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (big if i is None else i):
                gone.update(range(k, k + 50))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, left, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    got = repeated_phrases.dedup_substrings(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert sum(x[3] > 0 for x in want) > 5
    if seed == 3:
        assert repeated_phrases.dedup_substrings(none).count() == 0


def test_automata_find_every_occurrence(monkeypatch):
    """Overlapping phrases, several automata a shard, phrases with words that no document has."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(20)] + ["", "x y"]
    phrases = [" ".join(rng.choice("abc") for _ in range(4)) for _ in range(30)] + ["a b q q", "x y", "a"]
    cut = lambda xs: repeated_phrases.Words(*repeated_phrases.buffers(pa.array(xs, pa.large_string())), repeated_phrases.SPACED)
    w, begun, want = cut(texts), 0, []
    for t in texts:
        ws = t.split()
        want += [begun + k for x in set(phrases) for k in range(len(ws)) if ws[k : k + len(x.split())] == x.split()]
        begun += len(ws)
    for size in (1000, 3):
        monkeypatch.setattr(repeated_phrases, "AUTOMATON_PHRASES", size)
        assert set(repeated_phrases.occurrences(w, cut(phrases)).tolist()) == set(want)


def test_nothing_recurs_without_the_automaton(spark, monkeypatch):
    """What is located comes from the automaton alone: without one no window is found."""
    rows = spark.createDataFrame([(1, "a b c d e f", ["b c"], 7), (2, "b c d", None, 7)], "key long, text string, phrases array<string>, mark long").coalesce(1)
    assert repeated_phrases.located(rows, 3, 2).count() > 0
    other = spark.createDataFrame([(1, "a b c d e f", ["c b"], 7)], rows.schema)
    assert repeated_phrases.located(other, 3, 2).count() == 0


def test_ids_of_other_types(spark):
    rng = random.Random(2)
    passage = " ".join(words(rng, 60))
    rows = [("b", "start " + passage), ("a10", passage + " end"), ("a9", "x " + passage), (None, passage), ("a10", passage + " end")]
    for kind, of in (("string", lambda x: x), ("double", {"b": 3.5, "a10": 1.5, "a9": 2.5, None: None}.get)):
        docs = spark.createDataFrame([(of(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(3)
        got = {r["doc_id"]: r["n_removed"] for r in repeated_phrases.dedup_substrings(docs).collect()}
        assert got == {of("b"): 60, of("a10"): 0, of("a9"): 60, None: 60}


def test_near_duplicates(spark, none):
    rng = random.Random(8)
    rows = list(odd_texts())
    for k in range(12):  # originals with copies that differ in a few words, and copies
        base = words(rng, rng.choice((12, 60, 200)))
        for j in range(rng.choice((1, 2, 12))):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60) if j else 0):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + 20 * k + j, " ".join(copy)))
    rows += [(2000, rows[-1][1].upper() + "!"), (2001, "a b c d"), (2002, "A, b; c d"), (2003, "a b c")]
    lone, twin = words(rng, 150), words(rng, 150)  # repeated ids with other texts; near copies of and among null ids
    rows += [(2100, " ".join(lone)), (2100, " ".join(twin)), (2101, " ".join([*lone[:-1], "x"])), (None, " ".join([*lone[1:], "y"])), (None, " ".join(["z", *twin])), (None, " ".join(["z", *twin])), (1000, " ".join(words(rng, 90)))]
    alone = words(rng, 120)
    rows += [(None, " ".join(alone)), (None, " ".join([*alone, "more"]))]
    sets = []
    for _, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(i)
    want = sorted(((i, min((x for x in classes[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)
    got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == want
    stays = near_duplicates.deduplicated(documents(spark, rows))
    assert stays.columns == ["doc_id", "text", "node", "hits", "row", "label"]
    left = {}
    for r in stays.collect():
        left.setdefault(next(find(k) for k, x in enumerate(rows) if x == (r["doc_id"], r["text"])), set()).add((r["doc_id"], r["text"]))
    for c in {find(k) for k in range(len(rows)) if sets[k]}:
        members = {x for k, x in enumerate(rows) if find(k) == c}
        ids = {i for i, _ in members if i is not None}
        assert len(left[c]) == 1 and left[c] <= members and next(iter(left[c]))[0] == (min(ids) if ids else None)
    assert sum(len(v) for k, v in left.items() if not sets[k]) == len({x for k, x in enumerate(rows) if not sets[k]})
    assert all(r["doc_id"] == r["class_id"] for r in got if r["kept"])
    assert near_duplicates.near_duplicates(none).count() == 0


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = random.Random(1)
    both = [rng.getrandbits(64) for _ in range(300)]
    a, b = both + [rng.getrandbits(64) for _ in range(100)], both + [rng.getrandbits(64) for _ in range(100)]
    row = np.array([0] * 400 + [1] * 400)
    found = near_duplicates.signatures(row, np.array(a + b, np.uint64), np.ones(800, np.int64), 2, 4096)
    assert abs((found[0] == found[1]).mean() - 300 / 500) < 0.04


def classes_by_brute_force(rows, least=0.8):
    """The smallest id of the class of each row, from every pair."""
    sets = []
    for _, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        lowest[find(k)] = min(i, lowest.get(find(k), i))
    return {i: lowest[find(k)] for k, (i, _) in enumerate(rows)}


def test_near_duplicates_links_every_family_and_chain_of_a_large_bucket(spark):
    rng = random.Random(21)
    template = words(rng, 400)
    texts: list[dict[int, str]] = []  # the five words in which each differs from the template: 8 places apart is 0.82 alike, 9 is 0.796

    def added(shared, near):
        while True:
            new = shared | {k: f"t{len(texts)}w{k}" for k in rng.sample(range(7, 393, 5), 5 - len(shared)) if k not in shared}
            apart = [sum(new.get(k) != x.get(k) for k in new.keys() | x.keys()) for x in texts]
            if len(new) == 5 and all((d <= 8) == (i in near) for i, d in enumerate(apart)):
                return texts.append(new)

    for _ in range(12):  # families of three that share one change
        first = len(texts)
        added({}, [])
        shared = dict([rng.choice(list(texts[-1].items()))])
        added(shared, [first])
        added(shared, [first, first + 1])
    added({}, [])
    for _ in range(19):  # a chain, of which only versions next to each other are alike
        new = [x for x in texts[-1].items() if x not in texts[-2].items()]
        added(dict([rng.choice(new)]), [len(texts) - 1])
    rows = [(i, " ".join(x.get(k, w) for k, w in enumerate(template))) for i, x in enumerate(texts)]
    want = classes_by_brute_force(rows)
    assert sorted(list(want.values()).count(x) for x in set(want.values())) == [3] * 12 + [20]
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(documents(spark, rows)).collect()} == want


def test_near_duplicates_joins_exactly_what_its_rounds_leave(spark, monkeypatch):
    rng = random.Random(22)
    template, rows = words(rng, 120), []
    for i in range(60):
        rows.append((i, " ".join(f"u{rng.randrange(3)}x{k}" if rng.random() < rng.choice((0.01, 0.05)) else x for k, x in enumerate(template))))
    monkeypatch.setattr(near_duplicates, "ROUNDS", 0)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(documents(spark, rows), bands=32, depth=1).collect()}
    assert got == classes_by_brute_force(rows)


def test_near_duplicates_asks_no_job_for_what_its_writes_have_counted(spark):
    """Each job costs the driver plans, threads and task events, at a cluster's partitions most."""
    rng, rows = random.Random(25), []
    for _ in range(6):
        text = words(rng, 150)
        rows += [(len(rows) + k, " ".join(f"u{rng.randrange(9)}" if rng.random() < 0.004 * k else x for x in text)) for k in range(8)]
    context = spark.sparkContext
    context.setJobGroup("near duplicates", "near duplicates")
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(documents(spark, rows)).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("near duplicates"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == classes_by_brute_force(rows)
    assert jobs <= 100, jobs


def test_classes_of_random_pairs_merge_round_by_round(spark):
    rng, roots, root = random.Random(26), None, {}

    def find(a):
        while root.get(a, a) != a:
            a = root[a]
        return a

    for n in (40, 25, 1, 0):
        pairs = [(rng.randrange(1, 90), rng.randrange(1, 90)) for _ in range(n)]
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        links, many = counted(spark.createDataFrame(pairs, "a long, b long"), "links")
        roots = near_duplicates.merged(roots, links, many, 1000)
        assert many == n and {r["node"]: r["root"] for r in roots.collect()} == {a: find(a) for a in root if find(a) != a}


def test_near_duplicates_links_texts_of_null_ids(spark):
    text = words(random.Random(23), 200)
    rows = [(None, " ".join(text)), (5, " ".join(["first", *text[1:]])), (6, " ".join([*text[:-1], "last"])), (None, "something else altogether for once"), (None, None)]
    got = near_duplicates.near_duplicates(documents(spark, rows)).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 5), (5, 5), (6, 5), (None, None), (None, None)], key=str)


def test_substring_dedup_of_a_copy_spares_other_texts_of_its_id(spark):
    rng = random.Random(24)
    shared, other, third, fourth = (" ".join(words(rng, 80, 10**6)) for _ in range(4))
    rows = [(1, shared), (None, shared), (None, other), (2, third), (2, shared), (3, f"{third} {fourth}"), (None, f"{fourth} tail")]
    got = repeated_phrases.dedup_substrings(documents(spark, rows)).select("doc_id", "kept").collect()
    want = [(1, shared), (None, ""), (None, other), (2, third), (2, ""), (3, fourth), (None, "tail")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
