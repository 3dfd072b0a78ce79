"""Compression of vectors to codes: each vector is cut into parts, each part is replaced by the index of its nearest codebook entry.

Codebooks come from Lloyd's rounds with Elkan's bounds.  Each vector keeps, for each part, an upper bound of the distance to its entry and one lower
bound for each entry.  After entries have moved, the upper bound grows by its entry's move and each lower bound shrinks by that of its
own; an entry is looked at only where neither its lower bound nor half the distance between it and the part's entry lies strictly above the
upper bound.  What is left is compared by squared distances of integers, the lower index winning ties.  Bounds are rounded outward
(lower ones are stored in a byte each), so they never hide an entry that is as near.

Components are integers: floor(1024 x).  Rounds are Spark jobs: one assigns and writes rows with their new bounds as a table in the shared folder (the table before
it is deleted then), one sums the parts of each entry, combined before the shuffle, to one row for each part and entry.  The
driver holds the codebooks: ``entries`` times the dimension, whatever the number of vectors.  Bounds take ``parts * entries`` bytes a row, and two tables with
bounds exist at most.

Defined results: rows go whose vector is null or empty, has a null or non-finite component, or another length than the vector of the least id
(the shortest of them if that repeats), or a component so large that squared distances leave 62 bits (128 * 1024 in parts of 16 numbers).
Where the length is no multiple of ``parts``, part p is the components from len*p//parts on.  Codebooks start from the least ids, nulls being the last, equal ids by
vector; with fewer vectors than entries they are shorter.  Repeated rows are rows of their own.  ``label_error`` is null where the sum leaves 64 bits.  An
empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import lean
from tallyroom.llm.tables import drop, kept

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a task works on at once: bounds what it holds.
ROWS = 1024
#: Room for the rounding of square roots and sums of bounds.
SLACK = 1e-9

Codebooks = list[np.ndarray]


def cuts(size: int, parts: int) -> list[tuple[int, int]]:
    return [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]


def scaled(vectors: DataFrame, vector: str, parts: int) -> DataFrame:
    """vec_id, label, v (integers): the rows that are worked on."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0)).select("vec_id", "label", F.col(vector).alias("v"))
    least = rows.select("vec_id", F.size("v").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1).collect()
    size = least[0]["n"] if least else 0
    widest = max((b - a for a, b in cuts(size, parts)), default=1)
    most = float(math.isqrt((1 << 60) // max(1, widest)) // 2)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    fits = F.forall("v", lambda x: F.abs(x.cast("double") * SCALE) < min(most, float(1 << 30)))
    return rows.where((F.size("v") == size) & fits).select("vec_id", "label", whole.alias("v"))


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(len(col), size)


def _stored(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Lower bounds in a byte each, as their ratio to the part's upper bound: 32 steps a doubling, from a quarter to 63 times that, rounded down; 0 says nothing.

    A lower bound far below the upper one prunes nothing, so little is lost."""
    ratio = lower / np.maximum(upper, 1.0)[..., None]
    with np.errstate(divide="ignore"):
        step = np.floor(32 * np.log2(ratio) - 1e-6) + 65
    return np.clip(step, 0, 255).astype(np.uint8)


def _restored(raw: np.ndarray, upper: np.ndarray) -> np.ndarray:
    return np.where(raw > 0, np.maximum(upper, 1.0)[..., None] * 2.0 ** ((raw.astype(np.float64) - 65) / 32), 0.0) * (1 - SLACK)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    reach = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * max(1, x.shape[1]) * int(reach) ** 2 < 1 << 53:  # then floating-point products are exact
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def first_assignment(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, exact squared distance to it, and lower bounds, of each row."""
    d2 = squared(x, c)
    at = d2.argmin(1)  # the first of equals
    return at, d2[np.arange(len(x)), at], np.sqrt(d2) * (1 - SLACK)


class Moved:
    """What a round's bounds need of a codebook: moves of its entries and half the distances between them."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        self.entries = now
        self.moves = np.sqrt(((now - before) ** 2).sum(1)) * (1 + SLACK)
        self.half = 0.5 * np.sqrt(squared(now, now)) * (1 - SLACK)


def reassigned(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry, upper bound and lower bounds of each row, and how many distances were computed; bounds come from before the move."""
    c, rows = moved.entries, np.arange(len(x))
    upper = (upper + moved.moves[at]) * (1 + SLACK)
    lower = np.maximum(lower - moved.moves, 0) * (1 - SLACK)
    own = np.zeros(lower.shape, bool)
    own[rows, at] = True

    def near(some: np.ndarray) -> np.ndarray:
        u = upper[some, None]
        return (lower[some] <= u) & (moved.half[at[some]] <= u) & ~own[some]

    loose = rows[near(rows).any(1)]
    exact = ((x[loose] - c[at[loose]]) ** 2).sum(1)
    upper[loose] = np.sqrt(exact) * (1 + SLACK)
    lower[loose, at[loose]] = np.sqrt(exact) * (1 - SLACK)
    k, entry = np.nonzero(near(loose))  # with the tightened bound
    d2 = ((x[loose[k]] - c[entry]) ** 2).sum(1)
    root = np.sqrt(d2)
    lower[loose[k], entry] = root * (1 - SLACK)
    at = at.copy()
    all_k, all_entry, all_d2 = np.r_[np.arange(len(loose)), k], np.r_[at[loose], entry], np.r_[exact, d2]
    order = np.lexsort((all_entry, all_d2, all_k))
    best = order[np.r_[True, np.diff(all_k[order]) > 0]] if len(order) else order
    at[loose] = all_entry[best]
    upper[loose] = np.sqrt(all_d2[best]) * (1 + SLACK)
    return at, upper, lower, len(loose) + len(k)


def _like(rows: DataFrame, tail: str) -> str:
    """A schema with the types that vec_id and label have."""
    kinds = dict(rows.dtypes)
    return f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, {tail}"


def _binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    width = matrix.itemsize * int(np.prod(matrix.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(len(matrix) + 1, dtype=np.int32) * width), pa.py_buffer(matrix)])


def _read(col: pa.Array, kind, shape: tuple) -> np.ndarray:
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], kind, count=(offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, offset=int(offsets[0])).reshape(len(col), *shape)


def assign(rows: DataFrame, codebooks: Codebooks, before: Codebooks | None, size: int) -> DataFrame:
    """``rows`` with code, upper and lower bounds, and how many distances that took; ``before``: the codebooks that their bounds belong to."""
    spans, n = cuts(size, len(codebooks)), len(codebooks[0])
    moved = [Moved(b, c) for b, c in zip(before, codebooks)] if before else None

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                v, k = _matrix(batch["v"], size), batch.num_rows
                code, upper, lower = np.empty((k, len(spans)), np.uint16), np.empty((k, len(spans))), np.empty((k, len(spans), n), np.uint8)
                computed = 0
                if moved:
                    old = _read(batch["code"], np.uint16, (len(spans),)), _read(batch["upper"], np.float64, (len(spans),)), _read(batch["lower"], np.uint8, (len(spans), n))
                for p, (a, b) in enumerate(spans):
                    if moved:
                        at, u, low, some = reassigned(v[:, a:b], old[0][:, p].astype(np.int64), old[1][:, p], _restored(old[2][:, p], old[1][:, p]), moved[p])
                    else:
                        at, d2, low = first_assignment(v[:, a:b], codebooks[p])
                        u, some = np.sqrt(d2) * (1 + SLACK), low.size
                    code[:, p], upper[:, p], lower[:, p] = at, u, _stored(low, u)
                    computed += some
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], _binary(code), _binary(upper), _binary(lower), pa.array([computed, *[0] * (k - 1)], pa.int64())], ["vec_id", "label", "v", "code", "upper", "lower", "computed"])

    return rows.mapInArrow(run, _like(rows, "code binary, upper binary, lower binary, computed long"))


def updated(rows: DataFrame, codebooks: Codebooks, size: int) -> Codebooks:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    spans, n = cuts(size, len(codebooks)), len(codebooks[0])
    widest = max(b - a for a, b in spans)
    names = [f"s{i}" for i in range(widest)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((len(spans), n), np.int64), [np.zeros((n, b - a), np.int64) for a, b in spans]
        for batch in batches:
            v, code = _matrix(batch["v"], size), _read(batch["code"], np.uint16, (len(spans),))
            for p, (a, b) in enumerate(spans):
                count[p] += np.bincount(code[:, p], minlength=n)
                np.add.at(sums[p], code[:, p], v[:, a:b])
        part, entry = np.nonzero(count)
        if len(part):
            full = np.zeros((len(part), widest), np.int64)
            for p, (a, b) in enumerate(spans):
                full[part == p, : b - a] = sums[p][entry[part == p]]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), *(pa.array(c) for c in full.T)], ["part", "entry", "n", *names])

    sums = rows.select("v", "code").mapInArrow(run, f"part int, entry int, n long, {', '.join(f'{s} long' for s in names)}")
    out = [c.copy() for c in codebooks]
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect():  # parts x entries rows at most
        a, b = spans[row["part"]]
        out[row["part"]][row["entry"]] = [row[s] // row["n"] for s in names[: b - a]]
    return out


def coded(rows: DataFrame, codebooks: Codebooks, size: int) -> DataFrame:
    """vec_id, label, code (hex), error: what the final codes say, errors computed from the vectors."""
    spans = cuts(size, len(codebooks))
    digits = max(2, len(f"{len(codebooks[0]) - 1:x}"))
    kinds = dict(rows.dtypes)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, code = _matrix(batch["v"], size), _read(batch["code"], np.uint16, (len(spans),))
            error = sum(((v[:, a:b] - codebooks[p][code[:, p]]) ** 2).sum(1) for p, (a, b) in enumerate(spans))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(["".join(f"{x:0{digits}x}" for x in r) for r in code.tolist()], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_sha256(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, int]:
    """Rows with their final codes, the codebooks, and the length of the vectors (0: no rows)."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("1 to 65536 entries")
    rows = kept(scaled(vectors, vector, parts), "vectors")
    starts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not starts:
        return rows, [], 0
    start = np.array([r["v"] for r in starts], np.int64)
    size = start.shape[1]
    codebooks, before = [start[:, a:b] for a, b in cuts(size, parts)], None
    for k in range(rounds + 1):
        done = rows
        rows = kept(assign(done, codebooks, before, size), f"bounds{k}")
        drop(done)
        if k < rounds:
            before, codebooks = codebooks, updated(rows, codebooks, size)
    return rows, codebooks, size


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector that is kept."""
    rows, codebooks, size = train(vectors, vector, parts, entries, rounds)
    if size:
        said = kept(coded(rows, codebooks, size), "codes")
        drop(rows)
    else:
        said = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    # written, so that the join is of two scans, which adaptive execution splits where a label is hot
    by_label = kept(said.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label_errors")
    joined = said.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same by all distances, in SQL; ids must be distinct."""
    codes = """a{k} AS MATERIALIZED (
  SELECT vec_id, p, v, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT x.vec_id, x.p, x.v, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS d
    FROM parts x JOIN c{k} c ON x.p = c.p) GROUP BY ALL
)"""
    means = """sums{k} AS (
  SELECT p, best.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL
), c{j} AS MATERIALIZED (
  SELECT p, e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{k} GROUP BY ALL) m USING (p, e)
)"""
    rows = "list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))"
    steps = [codes.format(k=k) + (",\n" + means.format(k=k, j=k + 1) if k < rounds else "") for k in range(rounds + 1)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS k
  FROM embeddings WHERE embedding IS NOT NULL AND len({rows}) = 0
), parts AS (
  SELECT vec_id, k, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, unnest(range(4)) AS u(p)
), c0 AS (
  SELECT p, k AS e, v FROM parts WHERE k < 256
), {", ".join(steps)}, said AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1
), labelled AS (
  SELECT s.*, k.label, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error FROM said s JOIN kept k USING (vec_id)
)
SELECT vec_id, code, error, label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM labelled
"""
