"""Language identification by interpolated Kneser-Ney character models.

Per language an order-``order`` model over the letters of each word, padded with boundaries.  The highest order uses counts,
lower orders the number of different symbols seen before a sequence; each order has one absolute discount.
Models of all languages share sorted arrays of 64-bit hashes: one of sequences with a row of log probabilities (one
a language, backed off where a language lacks the sequence) and one of contexts with their back-off weights.
The language of the lowest cross-entropy per symbol wins.

Rejection is calibrated on labelled documents that gave no counts: of each language, a document whose
cross-entropy lies more than ``slack`` times as far above the language's mean as that of ``accept`` of them
(further for short texts) counts as no known language.

Null and empty texts and texts without a letter are ``und`` with score 0 and rejected.  Repeated rows give
repeated rows.  With no labelled row at all every document is ``und``.  Of languages of equal cross-entropy the first by name wins.  Very long texts are
scored whole, in sums over their chunks.  Empty tables give empty tables.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import MASK, lean, mix
from tallyroom.llm.chunks import Cache, chunked, segment_sums
from tallyroom.llm.tables import followed, whole_row

ORDER = 5
#: Bounds of the labelled sample, in expected documents a language.
TRAIN_DOCS, CALIBRATION_DOCS = 1_500, 500
ACCEPT = 0.9995
#: What is allowed beyond, as a multiple; and the distance (nats times the root of symbols) that counts at least, since a few hundred
#: calibration texts need not hold the rarer kinds of clean ones.
SLACK, LEAST_DISTANCE = 3.0, 3.0
#: Symbols from which a text counts as long.
LONG = 200
#: Bounds of the chunks that a task remembers, and of the text that it works on at once.
CHUNKS, SLICE_BYTES = 120_000, 2 << 20
BASE = 0xA24BAED4963EE407
LETTERS = regex.compile(r"\p{L}+")


def letters(chunk: str) -> list[str]:
    return LETTERS.findall(chunk.lower())


def _symbols(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1))


def _roll(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1..order symbols that end at each place (short ones near the beginning are of no use)."""
    out, run = [], np.zeros(len(symbols), np.uint64)
    for n in range(order):
        moved = np.zeros_like(symbols)
        moved[n:] = symbols[: len(symbols) - n]
        run = run + moved * np.uint64(pow(BASE, n, 1 << 64))
        out.append(mix(run + np.uint64(n + 1)))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Models:
    """Built from (language, sequence of ``order`` symbols as text, count) rows, a list or a table; chr(0) is the boundary."""

    def __init__(self, rows: list[tuple[str, str, int]] | pa.Table, order: int = ORDER):
        self.order = order
        if not isinstance(rows, pa.Table):
            rows = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())))})
        coded = rows.column("lang").combine_chunks().dictionary_encode()
        named = coded.dictionary.to_pylist()
        self.langs = sorted(named)
        size = len(self.langs)
        joined = "".join(rows.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(joined, np.uint32).astype(np.int64).reshape(rows.num_rows, order)
        lang = np.array([self.langs.index(x) for x in named], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        sym = _symbols(points)
        size_v = len(np.unique(points[:, -1])) + 1

        def hashes(cols: np.ndarray) -> np.ndarray:
            run = np.zeros(len(cols), np.uint64)
            for n in range(cols.shape[1]):
                run = run + cols[:, cols.shape[1] - 1 - n] * np.uint64(pow(BASE, n, 1 << 64))
            return mix(run + np.uint64(cols.shape[1])) if cols.shape[1] else np.zeros(len(cols), np.uint64)

        # for each order: distinct sequences of each language with their counts
        levels = []
        count = rows.column("n").to_numpy().astype(np.float64)
        for n in range(order, 0, -1):
            levels.append((lang, sym, hashes(sym), hashes(sym[:, :-1]), hashes(sym[:, 1:]), count))
            if n > 1:
                key = np.stack([lang.astype(np.uint64), hashes(sym[:, 1:])])
                _, first, times = np.unique(key, axis=1, return_index=True, return_counts=True)
                lang, sym, count = lang[first], sym[first, 1:], times.astype(np.float64)
        self.keys, self.logp, self.contexts, self.weights = [], [], [], []
        self.base = np.full(size, -np.log(size_v))
        for n, (lang, _, gram, context, suffix, count) in enumerate(reversed(levels), 1):
            keys, first = np.unique(gram, return_index=True)
            ctx_keys = np.unique(context)
            # what the next lower order says of each sequence, for all languages
            if n == 1:
                lower = np.tile(self.base, (len(keys), 1))
            else:
                at, ok = _find(self.keys[-1], suffix[first])
                assert ok.all()
                lower = self.logp[-1][at].astype(np.float64)
            logp = np.empty((len(keys), size))
            weights = np.zeros((len(ctx_keys), size))
            ctx_of_key = np.searchsorted(ctx_keys, context[first])
            for k in range(size):
                own = lang == k
                c, ctx = count[own], np.searchsorted(ctx_keys, context[own])
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
                total = np.bincount(ctx, c, len(ctx_keys))
                kinds = np.bincount(ctx, minlength=len(ctx_keys))
                seen = total > 0
                weights[seen, k] = np.log(discount * kinds[seen] / total[seen])
                logp[:, k] = weights[ctx_of_key, k] + lower[:, k]
                at = np.searchsorted(keys, gram[own])
                logp[at, k] = np.log(np.maximum(c - discount, 0) / total[ctx] + np.exp(logp[at, k]))
            self.keys.append(keys)
            self.logp.append(logp.astype(np.float32))
            self.contexts.append(ctx_keys)
            self.weights.append(weights.astype(np.float32))

    def score(self, words: list[list[str]]) -> np.ndarray:
        """For each list of words: log probability under each language, and the number of symbols."""
        pad = chr(0) * (self.order - 1)
        texts = [pad + w + chr(0) for ws in words for w in ws]
        owner = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        out = np.zeros((len(words), len(self.langs) + 1))
        if not texts or not self.langs:
            return out
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        hashes = _roll(_symbols(flat), self.order)
        starts = np.cumsum(sizes) - sizes
        real = np.ones(len(flat), bool)
        for n in range(self.order - 1):
            real[starts + n] = False
        at = np.flatnonzero(real)
        total = np.zeros((len(at), len(self.langs)))
        open_ = np.arange(len(at))
        for n in range(self.order, 0, -1):
            where, ok = _find(self.keys[n - 1], hashes[n - 1][at[open_]])
            total[open_[ok]] += self.logp[n - 1][where[ok]]
            open_ = open_[~ok]
            if not len(open_):
                break
            if n > 1:
                where, ok = _find(self.contexts[n - 1], hashes[n - 2][at[open_] - 1])
                total[open_[ok]] += self.weights[n - 1][where[ok]]
            else:
                total[open_] += self.weights[0][0] + self.base
        who = np.repeat(owner, sizes - (self.order - 1))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(who, total[:, k], len(words))
        out[:, -1] = np.bincount(who, minlength=len(words))
        return out


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """lang, sequence, count over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = chr(0) * (order - 1)
        for batch in batches:
            seen: Counter = Counter()
            langs = batch.column(0).to_pylist()
            for lo, _, at, codes, chunks in chunked(batch.column(1)):
                words = [letters(c) for c in chunks]
                owner = np.repeat([langs[lo + i] for i in range(len(at) - 1)], np.diff(at)) if len(codes) else []
                for (lang, code), times in Counter(zip(owner, codes.tolist())).items():
                    for w in words[code]:
                        text = pad + w + chr(0)
                        for i in range(len(w) + 1):
                            seen[lang, text[i : i + order]] += times
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_pydict({"lang": [str(k[0]) for k in keys], "gram": [k[1] for k in keys], "n": pa.array(list(seen.values()), pa.int64())})

    return docs.select("lang", "text").mapInArrow(lean(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _scored(docs: DataFrame, shared, limits: dict | None, inner: int | None = None) -> DataFrame:
    """Puts what the models say of each text, the last column, in its place; with ``inner`` beside the rows, whose field of that number is the text."""
    outer = docs.columns if inner is not None else docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        langs = np.array([*models.langs, "und"], object)
        size = len(models.langs)
        cache = Cache(lambda chunks: models.score([letters(c) for c in chunks]), np.float32, CHUNKS)
        for batch in batches:
            for lo, hi, at, codes, chunks in chunked(batch.column(len(outer)) if inner is None else batch.column(0).field(inner), SLICE_BYTES):
                rows, _ = cache.expand(chunks, codes)
                sums = segment_sums(rows.reshape(-1, size + 1).astype(np.float64), at)
                n = sums[:, -1]
                heard = (n > 0) & (size > 0)
                entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
                best = np.where(heard, entropy.argmin(1), size) if size else np.full(hi - lo, size)
                cols = {name: batch.column(i)[lo:hi] for i, name in enumerate(outer)}
                low = entropy.min(1) if size else np.zeros(hi - lo)
                odds = np.exp((low[:, None] - entropy) * np.minimum(n, 64)[:, None]).sum(1) if size else np.ones(hi - lo)
                cols |= {"lang_pred": pa.array(langs[best], pa.string()), "score": np.where(heard, 1 / np.maximum(odds, 1e-300), 0.0), "entropy": pa.array(low, mask=~heard), "symbols": n.astype(np.int64)}
                if limits is not None:
                    mean = np.array([limits[x][0] if x in limits else np.inf for x in langs])[best]
                    most = np.array([limits[x][1] if x in limits else np.inf for x in langs])[best]
                    cols["rejected"] = ~heard | ((low - np.where(np.isinf(mean), 0, mean)) * np.sqrt(np.minimum(n, LONG)) > most)
                yield pa.RecordBatch.from_pydict(cols)

    return docs.mapInArrow(lean(run), followed(docs.select(*outer), "lang_pred string, score double, entropy double, symbols long" + (", rejected boolean" if limits is not None else "")))


def identify(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS, accept: float = ACCEPT, slack: float = SLACK, carry: bool = False) -> DataFrame:
    """doc_id (or with ``carry`` the whole ``row`` as a struct), lang_pred, score, entropy (nats a symbol), symbols, rejected: one row per document.

    ``labelled`` says which rows may be learnt from.  Of them a sample chosen by a hash of id and text, about
    ``train_docs`` and ``calibration_docs`` a language, is; the counts that leave the executors are bounded by
    it.  Prediction reads every whole text once, without a shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), labelled.alias("labelled"))
    taught = rows.where("labelled AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    if sizes:
        share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 1.0 / n)]), F.col("lang"))
        sample = taught.withColumn("at", draw / share)
    else:
        sample = taught.withColumn("at", F.lit(0.0))
    sample = sample.where(F.col("at") < train_docs + calibration_docs).withColumn("held", F.pmod(F.xxhash64("doc_id", "text", F.lit("calibration")), F.lit(train_docs + calibration_docs)) < calibration_docs)
    models = Models(_counts(sample.where("NOT held"), order).toArrow(), order)
    shared = spark.sparkContext.broadcast(models)
    held = sample.where("held").select("lang", "text")
    seen: dict[str, list] = {}
    for r in _scored(held, shared, None).select("lang", "lang_pred", "entropy", "symbols").where("lang = lang_pred").collect():
        seen.setdefault(r["lang"], []).append((r["entropy"], r["symbols"]))
    limits = {}
    for k, v in seen.items():
        e = np.array(v, np.float64)
        mean = float(np.average(e[:, 0], weights=np.minimum(e[:, 1], LONG)))
        limits[k] = (mean, slack * max(float(np.quantile((e[:, 0] - mean) * np.sqrt(np.minimum(e[:, 1], LONG)), accept)), LEAST_DISTANCE))
    if carry:
        return _scored(docs.select(whole_row(docs)), shared, limits, docs.columns.index(text_col))
    return _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shared, limits)
