"""Benchmark decontamination by a prefix-filtered set join.

Each item gives windows of ``width`` consecutive words (one window if it has fewer); equal windows are one, with a list of items.  A document
contains a window only if it has all of its words, so of the window's words, ordered from rare to common over the corpus,
the prefix that must match is the first: the rarest.  Documents offer what stands around such words: for each place that a rarest word has in a
window and each size of windows, the words that a window with it there would cover, if they lie within the document (position and length bounds).
Offers meet windows in one join, by the rarest word, its place, the size and a hash of all words, and what remains is verified by the words themselves.

Three passes go over the documents, whatever the size of the benchmark: one counts its words in all documents, one makes the offers, one
carries the result to the rows.  Two filters of fixed size, one of words and one of windows, keep what can match nothing from being shuffled; a benchmark that fills
them costs time, not rows.  Windows, counts and offers are tables that Spark joins; where a window, a word or a text has a share of all rows, the join is of two plain scans,
which adaptive execution splits.  Nothing of the benchmark passes through the driver but the filters.

Words are lower-cased (A-Z) runs of ASCII letters, digits and everything beyond ASCII.  Nulls and empty texts have no words.
Items without words have no windows.  Equal windows of several items count for each; a repeated item
counts once; an item without an id is named by an empty text.  Words that are equally rare are ordered by their hash, equal words of a window by their place.
What a document contains depends on its text alone, so results are made once for each text (told apart by SHA-256) and every row gets those of its text; repeated
rows are documents of their own.  Very long texts are worked on whole.
An empty benchmark contaminates nothing, an empty table gives an empty table, and other columns, whatever their names, are not read (with
``carry`` they stay in the row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.arrays import ALNUM, LOWER, Words, buffers, lean, ragged, words_of
from tallyroom.llm.tables import followed, kept, whole_row

WIDTH = 10
#: Bits of the filters of words and of windows, as powers of two.
WORD_BITS, WINDOW_BITS = 23, 24
#: Offers that are looked at at once.
MOST_OFFERS = 500_000


def _said(w: Words, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words of spans as texts, in lower case with one space between."""
    data, start, end = LOWER[w.data].tobytes(), w.start, w.end
    texts = [b" ".join(data[a:b] for a, b in zip(start[i : i + n].tolist(), end[i : i + n].tolist())) for i, n in zip(first.tolist(), size.tolist())]
    return pa.array(texts, pa.binary()).cast(pa.string())


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(item, span, size, words, said) of every window of (item, text): its hash, its number of words, their hashes and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            w = Words(data, offsets, ALNUM, lower=True)
            full, _ = w.windows(width)
            short = np.flatnonzero((w.count > 0) & (w.count < width))
            first = np.concatenate([full, w.first[:-1][short]]).astype(np.int64)
            size = np.concatenate([np.full(len(full), width), w.count[short]]).astype(np.int64)
            if not len(first):
                continue
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(w.hash[ragged(first, size)].view(np.int64)))
            yield pa.RecordBatch.from_pydict({"item": batch.column(0).take(pa.array(w.row[first])), "span": w.spans(first, first + size).view(np.int64), "size": size.astype(np.int32), "words": words, "said": _said(w, first, size)})

    return items.mapInArrow(lean(run), "item string, span long, size int, words array<long>, said string")


def _filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value that the hashes have in their lowest bits."""
    bit = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = hashes.select(F.shiftright(bit, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)  # so many rows at most
    out[rows["at"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def _passed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((len(bits) << 6) - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def word_counts(texts: DataFrame, shared) -> DataFrame:
    """(word, n): how often the words that pass the filter are in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [w.hash[_passed(shared.value, w.hash)] for _, _, w in words_of(batch.column(0), ALNUM, lower=True)]
            words, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n.astype(np.int64)})

    return texts.select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def offers(texts: DataFrame, shared, forms: list[tuple[int, int]]) -> DataFrame:
    """(digest, first, lead, place, size, span, said): what stands around words that pass the filter, in the ``forms`` (place, size) that windows have."""
    columns = ("digest", "first", "lead", "place", "size", "span", "said")
    places, sizes = np.array([f[0] for f in forms], np.int64), np.array([f[1] for f in forms], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, spans = shared.value
        most = max(1, MOST_OFFERS // max(1, len(forms)))
        for batch in batches:
            for lo, _, w in words_of(batch.column(1), ALNUM, lower=True):
                every = np.flatnonzero(_passed(leads, w.hash))
                for k in range(0, len(every), most):
                    at = np.repeat(every[k : k + most], len(forms))
                    place, size = np.tile(places, len(at) // len(forms)), np.tile(sizes, len(at) // len(forms))
                    first, row = at - place, w.row[at]
                    ok = (first >= w.first[row]) & (first + size <= w.first[row + 1])
                    at, place, size, first, row = at[ok], place[ok], size[ok], first[ok], row[ok]
                    span = w.spans(first, first + size)
                    ok = _passed(spans, span)
                    if ok.any():
                        at, place, size, first, row, span = at[ok], place[ok], size[ok], first[ok], row[ok], span[ok]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array((first - w.first[row]).astype(np.int32)), pa.array(w.hash[at].view(np.int64)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(span.view(np.int64)), _said(w, first, size)], columns)

    return texts.select("digest", "text").mapInArrow(lean(run), "digest binary, first int, lead long, place int, size int, span long, said string")


def _runs(spans: DataFrame) -> DataFrame:
    """digest, hits, n_hit: first and past-last words of the merged runs of (digest, first, last) spans, as a flat array, and how many words they cover."""
    order = Window.partitionBy("digest").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    runs = opened.groupBy("digest", "run").agg(F.min("first").alias("a"), F.max("last").alias("b"))
    said = runs.groupBy("digest").agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("s"), F.sum(F.col("b") - F.col("a")).alias("n_hit"))
    return said.select("digest", F.flatten("s").alias("hits"), "n_hit")


def found_in(texts: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """digest, hits, n_hit, items: of each text (digest, text) that contains a window of (item, text)."""
    session = texts.sparkSession.sparkContext
    every = kept(windows_of(items, width), "windows")
    different = every.groupBy("span", "size", "said").agg(F.first("words").alias("words"))
    named = different.select("span", "size", "said", F.posexplode("words").alias("place", "word"))
    words = session.broadcast(_filter(every.select(F.explode("words").alias("word")), "word", WORD_BITS))
    counts = kept(word_counts(texts, words), "word-counts")
    rarest = named.join(counts, "word").groupBy("span", "size", "said").agg(F.min(F.struct("n", "word", "place")).alias("r"))
    leads = kept(rarest.select("span", "size", "said", F.col("r.word").alias("lead"), F.col("r.place").alias("place")), "leads")
    forms = [(r["place"], r["size"]) for r in leads.select("place", "size").distinct().collect()]  # width * (width + 1) / 2 at most
    filters = session.broadcast((_filter(leads, "lead", WORD_BITS), _filter(leads, "span", WINDOW_BITS)))
    hits = kept(offers(texts, filters, sorted(forms)).join(leads, ["lead", "place", "size", "span", "said"]).select("digest", "first", "size", "span", "said").distinct(), "hits")
    runs = _runs(hits.select("digest", "first", (F.col("first") + F.col("size")).alias("last")).distinct())
    names = hits.select("digest", "span", "size", "said").distinct().join(every.select("item", "span", "size", "said").distinct(), ["span", "size", "said"]).select("digest", "item").distinct()
    lists = names.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return runs.join(lists, "digest").select("digest", "hits", "n_hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, carry: bool = False) -> DataFrame:
    """doc_id (or with ``carry`` the whole ``row`` as a struct), n_words, n_hit, hits (array<int>: first and past-last word of each run of hit words), items
    (ids as text), n_items, items_sha256, contaminated: one row per document."""
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")
    found = kept(found_in(docs.select(digest, F.col(text_col).alias("text")), items, width), "contaminated")
    head = whole_row(docs) if carry else F.col(id_col).alias("doc_id")
    rows, inner = docs.select(head, digest, *([] if carry else [F.col(text_col).alias("text")])), docs.columns.index(text_col)  # a text goes to Python once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in words_of(batch.column(0).field(inner) if carry else batch.column(2), ALNUM, lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(w.count.astype(np.int64))], [batch.schema.names[0], "digest", "n_words"])

    counted = rows.mapInArrow(lean(run), followed(rows.select(rows.columns[0], "digest"), "n_words long"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    said = counted.join(found, "digest", "left").select(rows.columns[0], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("hits", "int"), none("items", "string"))
    return said.select("*", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same result in DuckDB.
ORACLE = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
