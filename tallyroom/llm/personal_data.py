"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans: the four base patterns (whose valid matches always stand), and wider ones: numbers in
the forms phones and cards are written in, base matches whose check failed, and spelt-out mail addresses.  Each
other proposal is described by its format (digits, groups, separators, checksums) and the words around it, and
scored by boosted trees.  A kind's threshold is the lowest score that keeps ``precision`` on examples held back
from training.  A proposal that overlaps a base span is dropped.  Of the others that reach their threshold, taken from left to right
(of the same beginning the longer first), one that overlaps the last one taken is dropped.

The trees are fitted once a session on examples made by rule (``EXAMPLES`` of them, the bound of what is learnt from), by
Spark's own gradient boosting, and applied as one column expression.  Everything about a text happens in its row: no shuffle,
no group, no Python on executors.

Cost: patterns match in one pass and take no stack (repeated groups are possessive, or turned into character runs after a
same-length rewrite of the separators that cannot belong to a match).  Spans are sorted once and swept from both ends;
running values come from ``_scan``, which works in blocks, so that n spans cost about n ** 1.5 small steps and a text of
100,000 spans takes seconds.  What later steps use more than once comes from a generator of one row (``_put``) or is bound to a
lambda variable (``_let``): a plain column would be put back into the lambdas that use it and computed once an element.

Nulls and empty texts have no spans (``redact`` leaves a null a null); empty tables give empty tables.  Very long texts are
worked on whole.  Positions count code points, ends are exclusive.  Repeated rows give repeated rows.  Other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION, TREES, DEPTH = 4_000, 0.99, 12, 4
NEAR = 28  # code points of context

#: Where none of these is in a text, no generator can match.
ANY = r"[0-9@]|\[at\]|\(at\)"
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|)"
RUN = "[0-9][0-9 -]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Groups of digits with one to three separators between; of any length, since the count of digits decides later.
LOOSE = r"(?<![0-9A-Za-z+.(-])\(?[0-9]++(?:[ ()./-]{1,3}+[0-9]++)*+"
#: The one form that is proposed inside longer runs of numbers too: three, three and four digits.
NATIONAL = r"(?<![0-9+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SPELT = rf"(?<![{LOCAL}])[{LOCAL}]++ ?[\[(]at[\])] ?[{LABEL}]++(?:(?: ?[\[(]dot[\])] ?|\.)[{LABEL}]++)++"
#: Fewest digits of a proposal and most, by generator.  Shorter numbers are too common in prose, longer ones are no phone or card.
DIGITS = {"ip": (4, 24), "card": (13, 24), "phone": (7, 24), "loose": (7, 15), "national": (10, 10)}
BLOCK, PIECE = 256, 1024

WORDS = {
    "phone": r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|appel|llame)\b",
    "card": r"\b(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay|payment)\b",
    "ip": r"\b(?:ip|address|host|server|login from|client|adresse)\b",
    "email": r"\b(?:e-?mail|contact|write|reach|kontakt|correo)\b",
    "other": r"\b(?:version|v|order|isbn|id|token|invoice|ref|serial|build|password|secret|page|total|date|sku|part no)\b|[=#$€%]",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _put(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row whatever is made of it."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


def _scan(items: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit`` (of type ``kind``) of each item and the state before it; ``step`` gives the state after it.

    An array is copied with each element put to it, so results are gathered in blocks and the blocks joined at the end."""
    none = F.array().cast(f"array<{kind}>")

    def inner(begin: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(begin.alias("state"), none.alias("out")), lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")))

    def outer(a: Column, block: Column) -> Column:
        return _let(inner(a["state"], block), lambda done: F.struct(done["state"].alias("state"), F.concat(a["out"], F.array(done["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    done = F.aggregate(blocks, F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer, lambda a: F.flatten(a["out"]))
    return F.when(F.size(items) > 0, done).otherwise(none)


SPAN = "struct<start:bigint,rank:int,end:bigint>"
HIT = "struct<start:bigint,rank:int,end:bigint,hit:string,before:string,after:string>"


def _hits(text: Column, pattern: str, kind: str) -> Column:
    """The pattern's matches in order: an array of (start, rank, end, hit, before, after)."""

    def placed(hits: Column, parts: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: (F.length(F.get(parts, i)) + F.length(h)).cast("long"))
        ends = lambda xs: _scan(xs, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s + x, "bigint")
        make = lambda ends: lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.get(ends, i).alias("end"), h.alias("hit"),
            F.right(F.get(parts, i), F.lit(NEAR)).alias("before"), F.left(F.get(parts, i + 1), F.lit(8)).alias("after"))
        return _let(sizes, lambda xs: _let(ends(xs), lambda e: F.transform(hits, make(e))))

    some = lambda t, hits: _let(F.split(t, pattern, -1), lambda parts: placed(hits, parts))
    return _let(text, lambda t: _let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) > 0, some(t, hits)).otherwise(F.array().cast(f"array<{HIT}>"))))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits, not empty, has a sound check digit."""
    backward = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(backward, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _sound(kind: str, hit: Column) -> Column:
    """The base rule's check of a match."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(hit))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _features(c: Column) -> list[Column]:
    """Format and context of a proposal with fields rank, hit, before, after."""
    hit, near = c["hit"], F.lower(c["before"])
    digits = _digits(hit)
    short = F.left(digits, F.lit(40))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    count = lambda p: F.regexp_count(hit, F.lit(p))
    flag = lambda x: x.cast("int")
    out = [
        F.length(digits), F.length(hit), F.size(groups), count(" "), count("-"), count(r"\."), count(r"[()]"), count("/"), flag(hit.startswith("+")),
        flag(F.when(F.length(digits) > 1, luhn(short)).otherwise(False)), F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.coalesce(F.array_min(F.transform(groups, F.length)), F.lit(0)),
        F.size(F.array_distinct(F.split(short, ""))), count("[A-Za-z]"), count("@|at"), flag(hit.rlike(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}")),
        *(flag(near.rlike(p)) for p in WORDS.values()), flag(c["before"].rlike("[A-Za-z0-9]$")), flag(c["after"].rlike("^[A-Za-z0-9]")), flag(c["after"].rlike("^ ?[€$%]")), c["rank"],
    ]
    return [x.cast("double") for x in out]


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[int, str, str, str, int]]:
    """(rank, hit, before, after, label) made by rule: numbers and addresses as people write them, and numbers that are none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "ing", "le", "de", "en", "os")) for _ in range(rng.randint(1, 4)))

    def checked(k: int) -> str:
        body = d(k - 1)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def spaced(text: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(text[at : at + k])
            at += k
        return sep.join(out)

    hints = {"phone": ["phone", "tel.", "call me at", "mobile:", "fax", "Telefon", "whatsapp"], "card": ["card", "visa", "credit card no.", "pay with", "Karte", "tarjeta"], "ip": ["ip", "host", "server", "login from", "client address"], "email": ["mail", "contact", "write to", "reach me:", "correo"], "other": ["version", "order", "ISBN", "id", "token =", "invoice", "ref", "serial", "build", "page", "total", "date", "#", "€"]}
    out = []
    for _ in range(n):
        said = lambda kind: f"{word()} {rng.choice(hints[kind])} "
        plain, sep = f"{word()} {word()} ", rng.choice(" -.")
        pick = rng.randrange(14)
        if pick == 0:
            row = ("phone", spaced(d(10), [3, 3, 4], sep), said("phone"), 1)
        elif pick == 1:
            row = ("phone", f"({d(3)}) {d(3)}-{d(4)}", rng.choice((said("phone"), plain)), 1)
        elif pick == 2:
            row = ("phone", "0" + spaced(d(9), rng.choice(([2, 3, 4], [3, 6], [1, 2, 2, 2, 2])), sep), said("phone"), 1)
        elif pick == 3:
            row = ("card", spaced(d(16), [4, 4, 4, 4], rng.choice(" -")), said("card"), 1)
        elif pick == 4:
            row = ("email", f"{word()}.{word()}{rng.choice((' [at] ', '(at)', '[at]', ' (at) '))}{word()}{rng.choice((' [dot] ', '.', '(dot)'))}{rng.choice(('com', 'org', 'net', 'de'))}", rng.choice((said("email"), plain)), 1)
        elif pick == 5:
            row = ("phone", rng.choice((f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1990, 2030)}", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}")), rng.choice((said("other"), plain)), 0)
        elif pick == 6:
            row = (rng.choice(("phone", "card")), d(rng.randint(7, 24)), rng.choice((said("other"), plain)), 0)
        elif pick == 7:
            row = ("ip", ".".join(str(rng.randint(0, 999)) for _ in range(4)), rng.choice((said("other"), plain)), 0)
        elif pick == 8:
            row = ("ip", ".".join(str(rng.randint(256, 400) if i == 3 else rng.randint(1, 255)) for i in range(4)), said("ip"), 0)
        elif pick == 9:
            row = ("phone", "+" + rng.choice((d(rng.randint(2, 6)), spaced(d(24), [6, 6, 6, 6], " "))), plain, 0)
        elif pick == 10:
            row = ("card", spaced(d(rng.randint(12, 20)), [rng.randint(1, 9), 20], rng.choice(" -")), rng.choice((said("other"), plain)), 0)
        elif pick == 11:
            row = ("card", rng.choice((d(16), d(15), spaced(d(16), [4, 4, 4, 4], rng.choice(" -")))), plain, 0)
        elif pick == 12:
            row = ("card", d(16), said("other"), 0)
        else:
            row = ("phone", spaced(d(rng.randint(7, 13)), [rng.randint(1, 4), rng.randint(1, 4), 8], sep), rng.choice((said("other"), plain)), 0)
        kind, hit, before, label = row
        out.append((KINDS.index(kind), hit, before[-NEAR:], rng.choice((" th", ". ", ", on", "\n")), label))
    return out


class Trees:
    """A fitted model as a column expression, with a threshold a kind."""

    def __init__(self, trees: list[tuple[float, list[str]]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    @staticmethod
    def _grow(lines: list[str], features: list[Column]) -> Column:
        line = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = Trees._grow(lines, features)
        lines.pop(0)  # Else
        return F.when(features[int(m[1])] <= float(m[2]), low).otherwise(Trees._grow(lines, features))

    def score(self, features: list[Column]) -> Column:
        total = reduce(lambda a, b: a + b, (F.lit(w) * self._grow(list(lines), features) for w, lines in self.trees))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total))


_fitted: dict[tuple, Trees] = {}


def fitted(spark: SparkSession, n: int = EXAMPLES, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Trees:
    """Boosted trees and calibrated thresholds, once a session and setting."""
    key = (spark.sparkContext.applicationId, n, trees, depth, precision)
    if key in _fitted:
        return _fitted[key]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(*x, float(y)) for *x, y in examples(n)], "rank int, hit string, before string, after string, label double").coalesce(1)
    told = _features(F.struct("rank", "hit", "before", "after"))
    named = rows.select("rank", "hit", "label", *(x.alias(f"f{i}") for i, x in enumerate(told)))
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(told))], outputCol="features").transform(named).withColumn("held", F.pmod(F.xxhash64("hit"), F.lit(4)) == 0)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=10).fit(vectors.where("NOT held").select("features", "label"))
    grown = []
    for w, t in zip(model.treeWeights, model.trees):
        grown.append((float(w), [x.strip() for x in t.toDebugString.splitlines()[1:] if x.strip()]))
    out = Trees(grown, [1.1] * len(KINDS))
    seen: list[list[tuple[float, float]]] = [[] for _ in KINDS]
    columns = [F.col(f"f{i}") for i in range(len(told))]
    for r in named.withColumn("held", F.pmod(F.xxhash64("hit"), F.lit(4)) == 0).where("held").select("rank", "label", out.score(columns).alias("p")).collect():
        seen[r["rank"]].append((r["p"], r["label"]))
    for k, found in enumerate(seen):
        right = 0
        for i, (p, label) in enumerate(sorted(found, reverse=True), 1):
            right += label
            if right >= precision * i and p >= 0.5:
                out.thresholds[k] = p
    _fitted[key] = out
    return out


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def _free(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap none of ``base``, in order of their beginnings, the longer first."""
    row = lambda s, at: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), at.alias("at"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: row(b, F.lit(-1))), F.transform(more, lambda s, i: row(s, i))))
    own = lambda x: x["at"] < 0

    def swept(xs: Column) -> Column:
        reached = _scan(xs, F.lit(0).cast("long"), lambda s, x: F.when(own(x), F.greatest(s, -x["back"])).otherwise(s), lambda s, x: ~own(x) & (x["start"] >= s), "boolean")
        ahead = _scan(F.reverse(xs), F.lit((1 << 63) - 1), lambda s, x: F.when(own(x), F.least(s, x["start"])).otherwise(s), lambda s, x: -x["back"] <= s, "boolean")
        return _let(reached, lambda r: _let(ahead, lambda a: F.filter(xs, lambda x, i: F.get(r, i) & F.get(a, F.size(xs) - 1 - i))))

    return _let(both, lambda xs: F.transform(swept(xs), lambda x: F.get(more, x["at"])))


def _apart(spans: Column) -> Column:
    """From left to right, spans that do not overlap the last one taken."""
    clear = _scan(spans, F.lit(0).cast("long"), lambda s, x: F.when(x["start"] >= s, x["end"]).otherwise(s), lambda s, x: x["start"] >= s, "boolean")
    return _let(clear, lambda ok: F.filter(spans, lambda _, i: F.get(ok, i)))


def _chosen(more: Column, model: Trees) -> Column:
    """The proposals whose score reaches the threshold of their kind."""
    limits = F.array(*map(F.lit, model.thresholds))
    told = F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.array(*_features(s)).alias("f")))
    width = len(_features(F.col("x")))
    good = lambda s: model.score([F.get(s["f"], F.lit(i)) for i in range(width)]) >= F.get(limits, s["rank"])
    return _plain(F.filter(told, good))


def _found(df: DataFrame, model: Trees) -> DataFrame:
    """Adds base and spans, arrays of (start, rank, end), ordered, to rows with a text _t that is not null; rank counts in ``KINDS``."""
    t, digits = F.col("_t"), lambda s: F.length(_digits(s["hit"]))
    runs = F.regexp_replace(t, r"(?<![0-9])[ -]|[ -](?![0-9])", "x")
    mail = F.when(t.contains("@"), F.regexp_replace(t, rf"\.(?![{LABEL}])", "_")).otherwise("")
    sought = {"email": (mail, EMAIL, "email"), "ip": (t, IP, "ip"), "card": (runs, RUN, "card"), "phone": (t, PHONE, "phone"), "loose": (t, LOOSE, "phone"), "national": (t, NATIONAL, "phone"), "spelt": (t, SPELT, "email")}
    none = F.array().cast(f"array<{HIT}>")
    some = lambda hits: F.when(F.col("_hot"), hits).otherwise(none)
    df = _put(df.withColumn("_hot", t.rlike(ANY)), **{f"_{name}": some(_hits(*how)) for name, how in sought.items()}).drop("_hot")

    def fits(name: str, test: Callable[[Column], Column]) -> Column:
        low, high = DIGITS[name]
        return F.filter(f"_{name}", lambda s: digits(s).between(low, high) & test(s))

    sound = [F.filter(f"_{k}", (lambda k: lambda s: _sound(k, s["hit"]))(k)) for k in KINDS]
    more = [fits(k, (lambda k: lambda s: ~_sound(k, s["hit"]))(k)) for k in ("ip", "card", "phone")]
    more += [fits(k, lambda s: ~s["after"].rlike("^[A-Za-z0-9]")) for k in ("loose", "national")]
    df = _put(df, base=F.array_sort(_plain(F.concat(*sound))), _more=F.concat(*more, "_spelt")).drop(*(f"_{name}" for name in sought))
    df = _put(df, _free=F.when(F.size("_more") > 0, _free(F.col("base"), F.col("_more"))).otherwise(none)).drop("_more")
    df = _put(df, _chosen=F.when(F.size("_free") > 0, _chosen(F.col("_free"), model)).otherwise(F.array().cast(f"array<{SPAN}>"))).drop("_free")
    return _put(df, spans=F.when(F.size("_chosen") > 0, F.array_sort(F.concat("base", _apart(F.col("_chosen"))))).otherwise(F.col("base"))).drop("_chosen")


def find(docs: DataFrame, text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), base and spans: arrays of (start, rank, end), ordered; rank counts in ``KINDS``."""
    df = _found(_numbered(docs, text_col), model or fitted(docs.sparkSession))
    return df.select(F.struct(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns))).alias("row"), "base", "spans")


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """Columns under their numbers, so that no name can clash, and the text as _t."""
    return docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).withColumn("_t", F.coalesce(F.col(f"_{docs.columns.index(text_col)}"), F.lit("")))


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """doc_id, a count of base spans a kind, base_sha256, spans: one row per document."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = _found(df, model or fitted(docs.sparkSession))
    counts = [F.size(F.filter("base", (lambda k: lambda x: x["rank"] == k)(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one, of the first one's kind.

    A text is cut into pieces of ``PIECE`` code points, and what stays between two spans is put together from the pieces it touches."""
    df = _found(_numbered(docs, text_col), model or fitted(docs.sparkSession)).drop("base")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans, pieces, reached, at = F.col("spans"), F.col("_pieces"), F.col("_reached"), docs.columns.index(text_col)

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        begin = lambda k: (first + k) * PIECE
        part = lambda p, k: F.substring(p, (F.greatest(a - begin(k), F.lit(0)) + 1).cast("int"), (b - F.greatest(a, begin(k))).cast("int"))
        return F.when(a < b, F.array_join(F.transform(F.slice(pieces, first + 1, last - first + 1), part), "")).otherwise("")

    some = F.size(spans) > 0
    running = _scan(spans, F.lit(0).cast("long"), lambda s, x: F.greatest(s, x["end"]), lambda s, x: s, "bigint")
    df = _put(df, _pieces=F.when(some, F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{PIECE}}}"), 0)), _reached=F.when(some, running))
    put = lambda s, i: F.when(s["start"] >= F.get(reached, i), F.concat(between(F.get(reached, i), s["start"]), F.get(names, s["rank"]))).otherwise("")
    rest = between(F.array_max(F.transform(spans, lambda s: s["end"])), F.length("_t").cast("long"))
    df = _put(df, _new=F.when(some, F.concat(F.array_join(F.transform(spans, put), ""), rest)).otherwise(F.col(f"_{at}")))
    return df.select(*(F.col("_new" if i == at else f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
