"""Filter audit, vector codes and chat texts against brute force, on odd inputs."""

import hashlib
import math
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tallyroom.llm import chat_format, filter_audit, vector_codes

from .conftest import words


# filter audit


def audited(rows, labels):
    """Every order applied to every document, one after another."""
    marks = {}
    for i, q, t in labels:
        if i is not None:
            good, toxic = marks.get(i, (False, False))
            marks[i] = (good or q == 1, toxic or t == 1)
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first.get(t, i) < i,
        }
        docs.append((lang or "", {f for f in fails if fails[f]}, *marks.get(i, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                earlier = [d for d in mine if f in d[1] and d not in left]
                kept = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in mine)
                out[part, "".join(order), k + 1] = [len(kept), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                assert failing - len(gone) >= 0 or earlier
                shapley[f] += len(gone)
                left = kept
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[f])
    return out


def test_filter_audit(spark, none):
    rng = random.Random(3)
    rows = [(1, None, "en"), (2, "", None), (3, "", "en"), (None, "", "en"), (None, "alone", ""), (4, "a b", "de"), (4, "a b", "de"), (3, "a b", "fr"), (5, "ß É Ü  \x1c A", "fr"), (6, "x" * 30_000, "de")]
    for i in range(10, 60):
        w = words(rng, rng.choice((20, 99, 100, 101, 300)), rng.choice((5, 4000)))
        text = rng.choice((" ", "\n\t", "  ")).join(w)
        text = text.upper() if rng.random() < 0.2 else text
        rows.append((i, text + rng.choice(("", "", " #", " |")), rng.choice(("en", "de", None))))
    rows += [(rng.randrange(100), t, lang) for _, t, lang in rng.sample(rows, 20)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in rng.choices(range(60), k=70)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(i, t, x, "n", 1) for i, t, x in rows], "doc_id long, text string, lang string, part string, subset int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.interactions(docs, table).collect()}
    assert found == audited(rows, labels)
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    duck.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in duck.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({filter_audit.ORACLE})").fetchall()} == found
    assert filter_audit.interactions(none.withColumn("lang", none["node"]), table).count() == 0


def test_a_hot_text_is_counted_once(spark):
    """One text in nearly all rows: all but the smallest id fail E, in every part."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 10 = 9, concat('t', id), 'same words') AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    found = filter_audit.interactions(docs, spark.createDataFrame([(0, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int"))
    first = {r["part"]: r for r in found.where("filter_order = 'EDCBA' AND step = 1").collect()}
    assert (first["en"]["removed"], first["de"]["removed"]) == (1499, 1200)
    assert (first["en"]["good_lost"], first["en"]["toxic_lost"]) == (1, 1)


# vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd's rounds by all distances, on Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[math.floor(1024 * float(np.float32(x))) for x in r[2]] for r in rows]
    size = len(whole[0])
    out, error, books = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        xs = [tuple(v[size * p // parts : size * (p + 1) // parts]) for v in whole]
        book = xs[:entries]
        for k in range(rounds + 1):
            d = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in book] for x in xs]
            at = [min(range(len(book)), key=lambda e: (row[e], e)) for row in d]
            if k < rounds:
                for e in range(len(book)):
                    mine = [x for x, a in zip(xs, at) if a == e]
                    if mine:
                        book[e] = tuple(sum(c) // len(mine) for c in zip(*mine))
        for i, a in enumerate(at):
            out[i] += f"{a:02x}"
            error[i] += d[i][a]
        books += [x for c in book for x in c]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((r[0], c, e, by_label[r[1]], digest) for r, c, e in zip(rows, out, error)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, x, "n", 1) for i, x, e in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("entries,size,spread", [(16, 8, 0.003), (16, 12, 1.0), (256, 8, 0.02), (3, 6, 100.0)])
def test_vector_codes(spark, entries, size, spread):
    """Narrow spreads give many equal distances and equal entries, wide ones large integers."""
    rng = random.Random(entries + size)
    centres = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(9)]
    rows = [(i, rng.choice((None, 1, 2)), [c + rng.gauss(0, spread / 4) for c in rng.choice(centres)]) for i in rng.sample(range(-50, 900), 220)]
    rows += rows[:5] + [(None, 1, rows[3][2]), (rows[0][0], 7, rows[1][2])] + [(1000 + k, 3, rows[9][2]) for k in range(60)]
    bad = [(-90, 1, None), (-91, 1, [math.nan] * size), (-92, 2, [math.inf] + [0.0] * (size - 1)), (-93, 2, [None] * size), (5000, 2, [0.0] * (size + 1)), (-94, 2, [])]
    found = vector_codes.compress(vectors(spark, rows + bad), entries=entries)
    assert sorted(map(tuple, found.collect()), key=str) == plain_codes(rows, entries=entries)


def test_few_vectors_far_ones_and_none(spark):
    rows = [(3, None, [0.5, -0.25, 0.0, 1.0]), (1, None, [0.1, 0.2, 0.3, 0.4])]
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, rows)).collect()), key=str) == plain_codes(rows)
    far = vector_codes.compress(vectors(spark, [*rows, (4, 1, [3e38, 0.0, 0.0, 0.0])]))  # its distances are beyond 64 bits
    assert {r["vec_id"] for r in far.collect()} == {1, 3}
    assert vector_codes.compress(vectors(spark, [])).count() == 0


def test_bounds_prune_and_hold():
    """After a round most distances are not computed, and no stored bound passes the distance that it bounds."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (32, 16))
    x = np.floor(centres[rng.integers(0, 32, 3000)] + rng.normal(0, 40, (3000, 16))).astype(np.int64)
    before = np.floor(centres + rng.normal(0, 30, centres.shape)).astype(np.int64)
    at, d2, lower = vector_codes.first_assignment(x, before)
    upper = np.sqrt(d2)
    lower = vector_codes._restored(vector_codes._stored(lower, upper), upper)
    assert (lower**2 <= vector_codes.squared(x, before)).all()
    now = np.stack([np.floor(x[at == e].mean(0)).astype(np.int64) if (at == e).any() else before[e] for e in range(32)])
    at, upper, lower, computed = vector_codes.reassigned(x, at, upper, lower, vector_codes.Moved(before, now))
    exact = vector_codes.squared(x, now)
    assert (at == exact.argmin(1)).all()
    assert (lower**2 <= exact).all() and (upper**2 >= exact[np.arange(len(x)), at] * (1 - 1e-12)).all()
    assert computed < 0.15 * exact.size


# chat texts


def said(rows):
    out = {}
    for i, turn, role, text in rows:
        out.setdefault(i, []).append((turn is not None, turn or 0, role or "", text or ""))
    result = {}
    for i, turns in out.items():
        turns.sort()
        spoken = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        result[i] = (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return result


def chats(spark, rows):
    return spark.createDataFrame([(i, k, r, t, "n", 1) for i, k, r, t in rows], "conv_id long, turn long, role string, text string, formatted string, turns int").repartition(3)


def odd_chats():
    rng = random.Random(8)
    pieces = ["</s>", "[INST]", "[/INST]", "[NEXT]", "<s>", "\\", "\\\\", "[", "<", "/s>", "[\\INST]", "\n", "", " ", "é😀", "$1", "user", "<pad>", "<", "[/", "NEXT]"]
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (1, 0, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, 5, "assistant", "x" * 300_000), (3, 1, "assistant", None), (4, 1, "[/INST]\n", "z")]
    for i in range(10, 60):
        for k in range(rng.randrange(1, 12)):
            rows.append((i, rng.randrange(5) if rng.random() < 0.3 else k, rng.choice(("user", "assistant", "assistant", "system", "tool[INST]")), "".join(rng.choices(pieces, k=rng.randrange(9)))))
    return rows


def test_chat_format(spark):
    rows = odd_chats()
    texts = chat_format.formatted(chats(spark, rows)).cache()
    found = {r[0]: tuple(r[1:5]) for r in chat_format.digests(texts).collect()}
    assert found == said(rows)
    template = chat_format.Template()
    for r in texts.collect():
        assert sum(x["chars"] for x in r["loss_mask"]) == len(r["formatted"])
        runs = re.findall(r"\[INST\](.*?)\[/INST\]", r["formatted"], re.S)
        assert all(a != b for a, b in zip(runs, runs[1:])), "neighbours of one role are one block"
        for mark in template.reserved:
            assert mark not in r["formatted"]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    expected = {r[0]: tuple(r[1:]) for r in duck.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({chat_format.ORACLE}) WHERE conv_id IS DISTINCT FROM -1").fetchall()}
    assert {r[0]: tuple(r[1:]) for r in chat_format.digests(texts).collect()} == expected
    assert chat_format.digests(chat_format.formatted(chats(spark, []))).count() == 0


def test_a_long_conversation(spark):
    """One conversation of 20,000 turns, most of one role."""
    rows = [(1, k, "assistant" if k % 50 else "user", f"turn {k} </s>") for k in range(20_000)]
    assert {r[0]: tuple(r[1:5]) for r in chat_format.digests(chat_format.formatted(chats(spark, rows))).collect()} == said(rows)


def test_the_mask_belongs_to_the_text(spark):
    texts = spark.createDataFrame([(1, "[INST]assistant[/INST]hello</s>", [(22, False), (4, True), (5, False)])], "conv_id long, formatted string, loss_mask array<struct<chars: int, loss: boolean>>")
    with pytest.raises(Exception, match="does not fit"):
        chat_format.digests(texts).collect()


def test_other_marks(spark):
    template = chat_format.Template("<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>", reserved=(), learned=("assistant", "tool"))
    rows = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "tool", "\\<|im_sep|>"), (1, 2, "assistant", "c")]
    texts = chat_format.formatted(chats(spark, rows), template)
    assert texts.first()["formatted"] == "<|im_start|>user<|im_sep|>a <\\|im_end|> b<|im_end|><|im_start|>tool<|im_sep|>\\\\<\\|im_sep|><|im_end|><|im_start|>assistant<|im_sep|>c<|im_end|>"
    assert texts.select(chat_format.learned_text(template)).first()[0] == "\\<|im_sep|>c"
    for bad in ({"end_turn": "[INST]"}, {"end_turn": "[a[b"}, {"escape": "//"}, {"next_text": "[IN\\"}, {"reserved": ("[INST] ",)}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)
