"""Text quality by Naive Bayes support vectors.

A text is a set of n-gram indicators: runs of one to three token shapes (letters as x or X, digits as 9, marks as
they are, runs shortened; a token equal to the one before is marked), and its words.  Each indicator is scaled by the log ratio
of its smoothed counts in the two classes; a linear model with hinge loss is fitted on the scaled, length-normalised
vectors by dual coordinate descent.  Margins become scores between 0 and 1 by a logistic curve fitted on labelled
rows held back from the descent.

Learnt from a sample of labelled rows, chosen by a hash of the id: about ``train_docs``, the bound of what leaves the
executors and of the label rows that are broadcast.  Scoring reads every whole text once, without a shuffle.

Null and empty texts have no indicators and get the score of the bias alone.  Null labels, and ids labelled both ways, teach nothing; with
labels of one class or none, every score is the share of label 1 (0.5 if none).  Very long texts are worked on whole, an empty table gives
an empty table, equal texts get equal scores, repeated rows give repeated rows, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import lean, mix
from tallyroom.llm.chunks import Cache, chunked

TRAIN_DOCS, LEAST_DOCS, COST, EPOCHS = 6_000, 5, 1.0, 30
FEATURE = np.uint64((1 << 44) - 1)
REPEATED = np.uint64(0x5851F42D4C957F2D)
TWO, THREE, WORD = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x27BB2EE687B0B0FD, 0x3C79AC492BA7B653))

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_MARKS = re.compile(r"(.)\1{3,}", re.S)


def shape(chunk: str) -> str:
    return _MARKS.sub(r"\1\1\1", _LOWER.sub("x", _DIGIT.sub("9", _UPPER.sub("X", chunk))))


def _numbers(chunks: list[str]) -> np.ndarray:
    return np.array([(zlib.crc32(shape(c).encode("utf-8", "replace")), zlib.crc32(c.lower().encode("utf-8", "replace"))) for c in chunks], np.uint32).reshape(-1, 2)


def indicators(codes: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct indicators of rows of chunks; features are 44-bit hashes."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(at))
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    token = mix(numbers[:, 0].astype(np.uint64))
    token[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])] ^= REPEATED
    word = mix(numbers[:, 1].astype(np.uint64) ^ WORD)
    found = [(row, token), (row, word)]
    if len(token) > 1:
        pair = mix(token[:-1] * TWO + token[1:])
        found.append((row[1:][row[1:] == row[:-1]], pair[row[1:] == row[:-1]]))
        if len(token) > 2:
            ok = row[2:] == row[:-2]
            found.append((row[2:][ok], mix(pair[:-1] * THREE + token[2:])[ok]))
    keys = np.unique(np.concatenate([(r << np.uint64(44)) | (v & FEATURE) for r, v in found]))
    return (keys >> np.uint64(44)).astype(np.int64), keys & FEATURE


class Model:
    """Sorted features, their log-count ratios and weights, and the curve from margins to scores."""

    def __init__(self, share: float):
        self.keys, self.ratio, self.weight = np.empty(0, np.uint64), np.empty(0), np.empty(0)
        self.bias, self.slope, self.shift = 0.0, 0.0, float(np.log(share / (1 - share)))

    def vectors(self, row: np.ndarray, feature: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, value) of the known indicators, of length 1 a row."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
        ok = self.keys[at] == feature
        row, at = row[ok], at[ok]
        value = self.ratio[at]
        norm = np.sqrt(np.bincount(row, value**2, rows))
        return row, at, value / np.where(norm == 0, 1, norm)[row]

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        row, at, value = self.vectors(row, feature, rows)
        margin = np.bincount(row, value * self.weight[at], rows) + self.bias if len(at) else np.full(rows, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(examples: list[tuple[np.ndarray, int, bool]], least_docs: int = LEAST_DOCS, cost: float = COST, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """``examples``: features, label, whether it is held back for the curve."""
    labels = np.array([e[1] for e in examples], np.int64)
    if len(examples) < 4 or labels.min() == labels.max():
        n = len(labels)
        return Model((labels.sum() + 1e-3) / (n + 2e-3))
    model = Model(0.5)
    held = np.array([e[2] for e in examples])
    if held.all() or len(set(labels[~held])) < 2:
        held[:] = False
    flat = np.concatenate([e[0] for e in examples])
    row = np.repeat(np.arange(len(examples)), [len(e[0]) for e in examples])
    taught = ~held[row]
    keys, place = np.unique(flat[taught], return_inverse=True)
    ones = labels[row[taught]] == 1
    good, bad = np.bincount(place[ones], minlength=len(keys)), np.bincount(place[~ones], minlength=len(keys))
    some = good + bad >= least_docs
    model.keys, good, bad = keys[some], good[some] + 1.0, bad[some] + 1.0
    model.ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    r, at, value = model.vectors(row, flat, len(examples))
    begin = np.searchsorted(r, np.arange(len(examples) + 1))
    # the dual of min |w|^2/2 + C sum hinge: one coordinate an example; the bias is a feature of value 1
    sign = np.where(labels == 1, 1.0, -1.0)
    weight, bias = np.zeros(len(model.keys)), 0.0
    alpha = np.zeros(len(examples))
    order = np.flatnonzero(~held)
    share = np.bincount(labels[order], minlength=2) / len(order)
    most = cost * np.where(labels == 1, 0.5 / share[1], 0.5 / share[0])
    square = np.bincount(r, value**2, len(examples)) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            a, b = begin[i], begin[i + 1]
            where, x = at[a:b], value[a:b]
            slope = sign[i] * (weight[where] @ x + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                weight[where] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    model.weight, model.bias = weight, float(bias)
    margin = np.bincount(r, value * weight[at], len(examples)) + bias
    some = held if held.any() and len(set(labels[held])) == 2 else ~held
    m, y = margin[some], labels[some]
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps with a little damping
        p = 1 / (1 + np.exp(-(slope * m + shift)))
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(max(slope, 1e-3)), float(shift)
    return model


def _features(docs: DataFrame, carried: str) -> DataFrame:
    """Columns before the text, and the distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(_numbers, np.uint32)
        for batch in batches:
            last = batch.num_columns - 1
            for lo, hi, at, codes, chunks in chunked(batch.column(last)):
                numbers, _ = cache.expand(chunks, codes)
                row, feature = indicators(codes, numbers.reshape(-1, 2), at)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                cols = {f.name: batch.column(i)[lo:hi] for i, f in enumerate(batch.schema) if i < last}
                yield pa.RecordBatch.from_pydict(cols | {"features": pa.array([feature[a:b].view(np.int64) for a, b in zip(ends, ends[1:])], pa.list_(pa.int64()))})

    return docs.mapInArrow(lean(run), f"{carried}, features array<bigint>")


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, score: one row per document.  ``learn`` says which label rows may be learnt from (a column over ``labels``)."""
    spark = docs.sparkSession
    known = labels.where(learn).select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    total = known.count()
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    sample = known.where(draw("quality sample") < train_docs / max(total, 1)).withColumn("held", draw("quality curve") < 0.2)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.join(F.broadcast(sample), "doc_id").select("label", "held", "text")
    told = _features(texts, "label int, held boolean").toArrow()
    lists = told.column("features").combine_chunks()
    values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().tolist()
    rows_ = zip(told.column("label").to_pylist(), told.column("held").to_pylist(), ends, ends[1:])
    examples = sorted(((values[a:b], y, held) for y, held, a, b in rows_), key=lambda e: (e[1], e[2], len(e[0]), e[0][:8].view(np.int64).tolist()))
    model = fit(examples)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(_numbers, np.uint32)
        for batch in batches:
            for lo, hi, at, codes, chunks in chunked(batch.column(1)):
                numbers, _ = cache.expand(chunks, codes)
                row, feature = indicators(codes, numbers.reshape(-1, 2), at)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[lo:hi], "score": shared.value.scores(row, feature, hi - lo)})

    return rows.mapInArrow(lean(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
