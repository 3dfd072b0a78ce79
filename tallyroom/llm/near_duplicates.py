"""Near-duplicate detection by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles (weight 1 + ln of how often it has one).  Each shingle
sends a Poisson process of arrivals, at a rate of its weight, to random slots of the signature; a slot keeps the
earliest arrival's shingle.  Arrivals later than a document's latest slot can change nothing, so its processes stop there.
Two signatures agree in a slot with the probability Jaccard similarity of the two sets.

Signatures are cut into bands; documents that agree in a whole band share a bucket.  With 16 bands of 4 a pair of
similarity 0.8 shares one with probability 0.9998.  A bucket of n documents yields no n*n pairs; it is worked off in rounds:

1. each document is verified against the most central document it shares a bucket with: the one whose buckets are
   largest together, which in a group of copies is what the others were made from,
2. in buckets that still hold several classes, against the most central document whose class has given none yet; this is
   repeated up to ``ROUNDS`` times and as long as it links anything,
3. documents of buckets that hold several classes even then are joined exactly: by the rarest shingles of their sets, of
   which two sets of similarity ``least`` have one in common, with bounds on sizes, on positions and on how far sketches of the sets differ.

Rounds 1 and 2 only keep large groups from being compared pair by pair; step 3 tries every pair that they left, whatever
the size of the bucket.  Shingles that only one class has can link nothing and count as the rarest.  In
round 2 signatures rule pairs out first (fewer than half of the slots agree); step 3 does without.
A verified pair has a Jaccard similarity of ``least`` or more of its sets of shingles.  Classes are the components of the
verified pairs, found by hooking larger roots onto smaller ones and jumping along pointers, each step written to
shared storage.

Documents of the same words are one node of all this, so copies cost a row each and no pair.  Words are lower-cased
runs of ASCII letters, digits and everything beyond ASCII; a document of fewer than five words is one shingle of all of them; one
without words (null and empty texts too) is in no class but its own.  Nodes are 64-bit hashes of word sequences, and rows are
told apart by their id and a 64-bit hash of their text, so a repeated id with other texts is several documents, and rows that
repeat both are one.  Null ids come after all others: they have classes and links like all rows, but are a class's id or its kept document
only where it has no other.  Ties of centrality go to the greater node.  Very long texts are worked on whole, one at a time; empty tables give empty
tables; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import ALNUM, Words, lean, mix, words_of
from tallyroom.llm.tables import counted, kept, observed, whole_row

SHINGLE, BANDS, DEPTH, LEAST, ROUNDS = 5, 16, 4, 0.8, 4
SLICE_BYTES = 1 << 20
#: Words of 64 bits of a set's sketch.
SKETCH = 16
#: A set of shingles is as wide as so many narrow rows.
SET_FILES = 12
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times) of the distinct shingles of each row, ordered by row and shingle."""
    at, value = w.windows(size)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    row = np.concatenate([w.row[at], short])
    value = np.concatenate([value, w.spans(w.first[:-1][short], w.first[1:][short])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    return row[begin], value[begin], np.diff(np.concatenate([begin, [len(row)]]))


def signatures(row: np.ndarray, value: np.ndarray, times: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """ProbMinHash of each row: a matrix of shingle hashes, zeros for rows without shingles."""
    weight = 1 + np.log(times)
    first = np.full(rows * slots, np.inf)
    chosen = np.zeros(rows * slots, np.uint64)
    live = np.arange(len(row))
    now = np.zeros(len(row))
    count = 0
    while len(live):
        many = 1 if len(live) > 4096 else 32
        draw = mix((value[live][:, None] + (np.arange(count, count + many, dtype=np.uint64) + np.uint64(1)) * STEP).ravel()).reshape(-1, many)
        count += many
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live][:, None]
        arrive = now[live][:, None] + np.cumsum(gap, axis=1)
        slot = (mix(draw.ravel()) % np.uint64(slots)).astype(np.int64).reshape(-1, many)
        place = (row[live][:, None] * slots + slot).ravel()
        flat = arrive.ravel()
        np.minimum.at(first, place, flat)
        best = flat <= first[place]
        chosen[place[best]] = np.repeat(value[live], many)[best]
        now[live] = arrive[:, -1]
        latest = first.reshape(rows, slots).max(1)
        live = live[now[live] < latest[row[live]]]
    return chosen.reshape(rows, slots)


def described(rows: DataFrame, size: int, bands: int, depth: int) -> DataFrame:
    """doc_id, mark, node, buckets, signs (a byte a slot) of rows doc_id, mark, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in words_of(batch.column(2), ALNUM, lower=True, limit=SLICE_BYTES):
                n = hi - lo
                found = signatures(*shingles(w, size), n, bands * depth)
                node = w.spans(w.first[:-1], w.first[1:]).view(np.int64)
                band = np.zeros((n, bands), np.uint64)
                for i in range(depth):
                    band = mix((band + found.reshape(n, bands, depth)[:, :, i]).ravel()).reshape(n, bands)
                band = mix((band + np.arange(1, bands + 1, dtype=np.uint64) * STEP).ravel())
                signs = (mix(found.ravel()) & np.uint64(255)).astype(np.uint8)
                width = bands * depth
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[lo:hi],
                    "mark": batch.column(1)[lo:hi],
                    "node": pa.array(node, mask=w.count == 0),
                    "buckets": pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(band.view(np.int64))),
                    "signs": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(signs.tobytes())]),
                })

    return rows.select("doc_id", "mark", "text").mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, node long, buckets array<bigint>, signs binary")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """node, set (sorted 32-bit hashes), sketch of rows text, node whose words are the node's.

    A sketch has a bit for each of ``64 * SKETCH`` groups of hashes: whether the set has an odd number of them.  Each hash that only
    one of two sets has changes one bit, so sketches differ in no more bits than sets in hashes."""

    def sketch(found: np.ndarray) -> np.ndarray:
        return np.packbits(np.bincount(found & np.uint32(64 * SKETCH - 1), minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(1).to_numpy()
            for lo, hi, w in words_of(batch.column(0), ALNUM, lower=True):
                row, value, _ = shingles(w, size)
                short = (value >> np.uint64(32)).astype(np.uint32)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                same = np.flatnonzero(w.spans(w.first[:-1], w.first[1:]).view(np.int64) == nodes[lo:hi]).tolist()
                sets = [np.unique(short[ends[i] : ends[i + 1]]) for i in same]
                yield pa.RecordBatch.from_pydict({"node": nodes[lo:hi][same], "set": pa.array([x.tobytes() for x in sets], pa.binary()), "sketch": pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))})

    return rows.select("text", "node").mapInArrow(lean(run), "node long, set binary, sketch array<bigint>")


def _with(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Pairs a, b with ``column`` of both nodes."""
    a = of.select(F.col("node").alias("a"), F.col(column).alias("left"))
    b = of.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "left", "right")


def possible(pairs: DataFrame, nodes: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs whose signatures agree in ``share`` of the slots at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            ok = pa.array((left == right).mean(1) >= share)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return _with(pairs, nodes, "signs").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs whose sets have a Jaccard similarity of ``least`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common >= least * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return _with(pairs, sets, "set").mapInArrow(lean(run), "a long, b long")


def flattened(parents: DataFrame, most: int) -> tuple[DataFrame, int]:
    """node, root: of a forest of (node, parent), parent < node, where every node leads to by pointer jumping; and how many nodes have a parent."""
    at = parents.select("node", F.col("parent").alias("root"))
    while True:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped, seen = observed(at.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "above"), "roots", most, nodes=F.count("*"), moved=F.count("above"))
        at = jumped.select("node", "root")
        if not seen["moved"]:
            return at, seen["nodes"]


def merged(roots: DataFrame | None, pairs: DataFrame, many: int, most: int) -> DataFrame | None:
    """node, root after joining the classes of ``many`` written ``pairs`` (a, b): larger roots hook onto the smallest root they meet, and
    chains are flattened, until no pair connects two roots.  Nodes that are missing are roots of themselves.  Where each larger root
    meets one other root only, hooking follows every pair, so none is left to look for."""
    hooked = 0
    while many > hooked:
        if roots is not None:
            a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
            pairs = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        pairs, many = counted(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", most)
        if not many:
            break
        hooks, hooked = flattened(pairs.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "node"), most)
        if roots is None:
            roots = hooks
        else:
            moved = roots.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            roots = kept(moved.union(hooks.join(roots.select("node"), "node", "left_anti")), "roots", most)
    return roots


def opened(member: DataFrame, roots: DataFrame | None, most: int) -> tuple[DataFrame, int]:
    """bucket, node, score, label: the members of buckets that hold several classes; and how many they are."""
    known = member if roots is None else member.join(roots, "node", "left")
    known = known.select("bucket", "node", "score", (F.coalesce("root", "node") if roots is not None else F.col("node")).alias("label"))
    several = kept(known.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket"), "open", most)
    return counted(known.join(several, "bucket"), "known", most)


def exploded(labelled: DataFrame) -> DataFrame:
    """node, label, size, shingle of rows node, label, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = 0, batch.num_rows
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            sizes = np.array([len(x) for x in sets], np.int64)
            while at < rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES >> 3)))
                n = sizes[at:to]
                names = {k: np.repeat(batch.column(i).to_numpy()[at:to], n) for i, k in enumerate(("node", "label"))}
                yield pa.RecordBatch.from_pydict({**names, "size": np.repeat(n, n), "shingle": np.concatenate(sets[at:to]).view(np.int32)})
                at = to

    return labelled.select("node", "label", "set").mapInArrow(lean(run), "node long, label long, size long, shingle int")


def remaining(labelled: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs a, b of different labels, among them every one whose sets have a Jaccard similarity of ``least`` at least.

    A set of n shingles has n - least * n others than those it must share, so among its n - least * n + 1 rarest is a shared one."""
    slack = 1e-6
    every, most = counted(exploded(labelled.join(sets, "node")), "shingles")
    counts = every.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    counts = kept(counts.where("x < y").select("shingle", "n"), "counts", most)
    held = every.join(counts, "shingle").groupBy("node", "label", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    wanted = F.floor(F.col("size") * (1 - least) + slack) + 1 - (F.col("size") - F.size("held"))
    held = held.withColumn("wanted", wanted.cast("int")).where("wanted > 0").join(sets.select("node", "sketch"), "node")
    rare = held.select("node", "label", "size", "sketch", F.size("held").alias("held"), F.posexplode(F.slice("held", F.lit(1), F.col("wanted"))).alias("at", "rare"))
    rare = kept(rare.select("node", "label", "size", "sketch", F.expr("held - at - 1").alias("after"), "at", F.col("rare.shingle").alias("shingle")), "rare", most)
    a, b = (rare.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "size", "sketch", "after", "at"))) for side in "ab")
    close = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - slack
    enough = F.least("at_a", "at_b") + 1 + F.least("after_a", "after_b") >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - slack
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH)))
    alike = apart <= (1 - least) / (1 + least) * (F.col("size_a") + F.col("size_b")) + slack
    met = a.join(b, "shingle").where(F.col("label_a") < F.col("label_b")).where(close & enough & alike)
    return kept(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "remaining")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, depth: int = DEPTH, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), kept (whether it is the first document of its class, by id and then by mark),
    mark (a hash of its text): one row per document."""
    rows = _identified(docs, id_col, text_col)
    told, total = counted(described(rows, size, bands, depth), "described")
    most = total * bands  # bounds the rows of every table below but sets and shingles
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    nodes = kept(told.where("node IS NOT NULL").groupBy("node").agg(F.min(own).alias("best"), F.min("buckets").alias("buckets"), F.min("signs").alias("signs")), "nodes", total)
    member = nodes.select(F.explode("buckets").alias("bucket"), "node")
    shared = kept(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets", most)
    member = kept(member.join(shared, "bucket"), "members", most)
    member = kept(member.join(member.groupBy("node").agg(F.sum("n").alias("score")), "node"), "members", most)
    central = kept(member.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top")), "central", most)
    wanted = member.select("node").distinct().join(nodes.select("node", "best.doc_id", "best.mark"), "node")
    same = rows["mark"].eqNullSafe(wanted["mark"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])
    sets = kept(shingle_sets(rows.join(wanted, same).select("text", "node"), size).dropDuplicates(["node"]), "sets", SET_FILES * total)

    first = member.join(central, "bucket").where("node <> top.node").groupBy("node").agg(F.max("top").alias("top"))
    links, many = counted(verified(first.select(F.col("node").alias("a"), F.col("top.node").alias("b")), sets, least), "links", most)
    roots = merged(None, links, many, most)
    known, left = opened(member.select("bucket", "node", "score"), roots, most)
    tops = None
    for _ in range(ROUNDS):
        if not left:
            break
        rest = known
        if tops is not None:
            past = kept(known.join(tops, ["bucket", "node"]).select("bucket", "label").distinct(), "past", most)
            rest = known.join(past, ["bucket", "label"], "left_anti")
        new = kept(rest.groupBy("bucket").agg(F.max(F.struct("score", "node", "label")).alias("top")), "tops", most)
        pairs = known.join(new, "bucket").where("label <> top.label").select("node", F.col("top.node").alias("other"))
        pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        links, many = counted(verified(possible(pairs, nodes), sets, least), "verified", most)
        if not many:
            break
        roots = merged(roots, links, many, most)
        past = new.select("bucket", F.col("top.node").alias("node"))
        tops = past if tops is None else tops.union(past)
        known, left = opened(known.drop("label"), roots, most)
    if left:
        links, many = counted(verified(remaining(known.select("node", "label").distinct(), sets, least), sets, least), "links", most)
        roots = merged(roots, links, many, most)
    named = nodes.select("node", "best")
    named = named.withColumn("label", F.col("node")) if roots is None else named.join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("label"))
    first = kept(named.groupBy("label").agg(F.min("best").alias("first")), "classes", total)
    classes = kept(named.join(first, "label").select("node", "first"), "classes", total)
    out = told.select("doc_id", "mark", "node").join(classes, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce(F.col("first").eqNullSafe(own) | F.col("node").isNull(), F.lit(True)).alias("kept"), "mark")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without those that are not the first of their class."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    mine = docs.select(whole_row(docs), F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_mark"))
    same = mine["own_mark"].eqNullSafe(gone["gone_mark"]) & mine["own_id"].eqNullSafe(gone["gone_id"])
    return mine.join(gone, same, "left_anti").select("row.*")


#: The same classes in DuckDB, from all pairs that share a shingle.
ORACLE = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, either.b FROM reach JOIN either ON reach.other = either.a)
SELECT doc_id, min(other) AS class_id, doc_id = min(other) AS kept FROM reach GROUP BY doc_id
"""
