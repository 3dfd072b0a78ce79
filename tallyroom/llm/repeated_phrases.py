"""Substring dedup with automata of repeated phrases.

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it also begins in a
document with a smaller id.  All is judged on the input.

1. Of every window, the ``phrase``-word sequence with the least hash stands for it.  Equal windows have equal
   least phrases, wherever they are, so windows can only recur where their least phrase does.  Each document
   gives its least phrases once each; those that two documents give are confirmed as recurring, and the document with the smallest id
   that has one says which words it is.
2. The words of its recurring phrases go to each document.  Documents are taken in shards of bounded size; of a shard's phrases an Aho-Corasick
   automaton is compiled, whose letters are words, and the shard's documents stream through it, which locates every
   occurrence.  Around these lie the windows that the phrases stand for; they are hashed.
3. A sum over all documents tells the windows that recur and gives each its smallest document.  Windows of later
   documents go back to these, whose words they cover are removed.

Exact copies of a longer document are set aside before step 1: all their words go, and their windows are those of the
smallest copy.  Sums are combined before they are shuffled and written as tables; so the joins that a hot phrase, window or copy
would skew are plain equi-joins of two scans, which adaptive execution splits.  No group is ever gathered into one task; what is gathered a
document is bounded by its length.

Words are runs of anything but ASCII white space.  Nulls and empty texts have no words.  A null id counts as larger
than all others; ids of other types than whole numbers are put in order first.  Rows with equal ids do not remove each other's words, and rows are told apart by id and a 64-bit hash
of their text: what befalls one row of an id says nothing of its other texts.  Texts shorter than a window are kept.  Very long
texts are worked on whole, an empty table gives an empty table, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm.arrays import SPACED, Words, buffers, lean, ragged, words_of
from tallyroom.llm.tables import kept
from tallyroom.operators.ranks import ranked

WIDTH, PHRASE = 50, 16
#: Bytes of text that share an automaton.
SHARD_BYTES = 512 << 10
#: Phrases of one automaton: bounds its nodes, and the letters that it needs.
AUTOMATON_PHRASES = 20_000
LAST = (1 << 63) - 1


def least_phrases(w: Words, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and the hash of its least phrase."""
    n = len(w)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n - phrase + 1)
    least = w.spans(at, at + phrase)
    reach, wanted = 1, width - phrase + 1
    while reach < wanted:  # minimum over ever longer ranges
        step = min(reach, wanted - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    first = np.flatnonzero(w.row[width - 1 :] == w.row[: n - width + 1])
    return first, least[first]


def candidates(rows: DataFrame, width: int, phrase: int) -> DataFrame:
    """(phrase, key, mark): each document's least phrases, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, _, w in words_of(batch.column(1), SPACED):
                first, least = least_phrases(w, width, phrase)
                if not len(first):
                    continue
                row = w.row[first]
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
                pairs = pd.DataFrame({"phrase": least[new].view(np.int64), "key": keys[lo + row[new]], "mark": marks[lo + row[new]]}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)

    return rows.select("key", "text", "mark").mapInArrow(lean(run), "phrase long, key long, mark long")


def phrase_words(rows: DataFrame, width: int, phrase: int) -> DataFrame:
    """(phrase, words) of the recurring ``phrases`` that rows are the first to have: the words themselves, one space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for lo, hi, w in words_of(batch.column(0), SPACED, limit=SHARD_BYTES):
                at, hashes = w.windows(phrase)
                named = lists[lo:hi].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                known = np.isin(hashes, named)
                _, first = np.unique(hashes[known], return_index=True)
                place = dict(zip(hashes[known][first].tolist(), at[known][first].tolist()))
                data, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
                found = [(x, place[x]) for x in dict.fromkeys(named.tolist()) if x in place]
                texts = [b" ".join(data[start[i] : end[i]] for i in range(k, k + phrase)) for _, k in found]
                yield pa.RecordBatch.from_pydict({"phrase": pa.array(np.array([x for x, _ in found], np.uint64).view(np.int64)), "words": pa.array(texts, pa.binary()).cast(pa.string())})

    return rows.select("text", "phrases").mapInArrow(lean(run), "phrase long, words string")


def _letters(codes: np.ndarray) -> str:
    """Numbers of words as a text with one character each; surrogates are no characters."""
    points = codes.astype("<u4") + np.uint32(1)
    points[points >= 0xD800] += np.uint32(0x800)
    return points.tobytes().decode("utf-32-le")


def occurrences(w: Words, phrases: Words) -> np.ndarray:
    """First words of every occurrence of ``phrases`` (one a row) in the rows of ``w``, by automata of so many phrases whose letters are words."""
    found: list[int] = []
    first, ends = w.first.tolist(), phrases.first.tolist()
    for lo in range(0, phrases.rows, AUTOMATON_PHRASES):
        hi = min(lo + AUTOMATON_PHRASES, phrases.rows)
        own = phrases.hash[ends[lo] : ends[hi]]
        letters = np.unique(own)
        if not len(letters):
            continue
        text = _letters(np.searchsorted(letters, own) + 1)
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for r in range(lo, hi):
            if ends[r + 1] > ends[r]:
                machine.add_word(text[ends[r] - ends[lo] : ends[r + 1] - ends[lo]])
        machine.make_automaton()
        code = np.minimum(np.searchsorted(letters, w.hash), len(letters) - 1)
        said = _letters(np.where(letters[code] == w.hash, code + 1, 0))  # 0: a word of no phrase
        for a, b in zip(first, first[1:]):
            found += [a + end - size + 1 for end, size in machine.iter(said[a:b])]
    return np.array(found, np.int64)


def located(rows: DataFrame, width: int, phrase: int) -> DataFrame:
    """(window, key, mark) of the windows that each document's recurring ``phrases`` (their words) stand for, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(np.asarray(batch.column(2).is_valid()))
            if not len(some):
                continue
            batch = batch.take(pa.array(some))
            keys, lists, marks = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for lo, hi, w in words_of(batch.column(1), SPACED, limit=SHARD_BYTES):
                data, offsets = buffers(lists[lo:hi].flatten().unique())
                start = occurrences(w, Words(data, offsets, SPACED))
                first, least = least_phrases(w, width, phrase)
                if not len(start) or not len(first):
                    continue
                first = first[np.isin(least, np.unique(w.spans(start, start + phrase)))]
                pairs = pd.DataFrame({"window": w.spans(first, first + width).view(np.int64), "key": keys[lo + w.row[first]], "mark": marks[lo + w.row[first]]}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)

    return rows.select("key", "text", "phrases", "mark").mapInArrow(lean(run), "window long, key long, mark long")


def removed(rows: DataFrame, width: int, id_type: str, keep_text: bool) -> DataFrame:
    kind = "kept string, " if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copies = batch.column(2), batch.column(3).to_pylist()
            valid = np.asarray(lists.is_valid())
            for lo, hi, w in words_of(batch.column(1), SPACED):
                gone = np.zeros(len(w), bool)
                first, windows = np.empty(0, np.int64), np.empty(0, np.uint64)
                if valid[lo:hi].any():
                    first, windows = w.windows(width)
                for r in np.flatnonzero(valid[lo:hi]).tolist():
                    a, b = np.searchsorted(first, [w.first[r], w.first[r + 1]])
                    bad = np.isin(windows[a:b], lists[lo + r].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    gone[ragged(first[a:b][bad], np.full(int(bad.sum()), width))] = True
                for r in range(hi - lo):
                    if copies[lo + r] and w.count[r] >= width:
                        gone[w.first[r] : w.first[r + 1]] = True
                data, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
                texts, lost = [], []
                for r in range(hi - lo):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    mask = gone[a:b]
                    lost.append(int(mask.sum()))
                    texts.append(b" ".join([data[start[i] : end[i]] for i in (np.flatnonzero(~mask) + a).tolist()]))
                cols = {"doc_id": batch.column(4)[lo:hi], "n_words": w.count, "n_removed": lost, "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}
                if keep_text:
                    cols["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({k: cols[k] for k in ("doc_id", *(["kept"] if keep_text else []), "n_words", "n_removed", "kept_sha256")})

    return rows.mapInArrow(lean(run), f"doc_id {id_type}, {kind}n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, phrase: int = PHRASE, *, keep_text: bool = True) -> DataFrame:
    """doc_id, kept (the words left, one space between; if ``keep_text``), n_words, n_removed, kept_sha256: one row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        place = F.col("doc_id").cast("long")
    else:
        order = kept(ranked(rows.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", name="place"), "order")
        rows, place = rows.join(order, "doc_id", "left"), F.col("place")
    rows = rows.select(F.coalesce(place, F.lit(LAST)).alias("key"), "text", "doc_id", F.xxhash64("text").alias("mark"))
    digests = rows.where(F.length("text") >= 2 * width - 1).select("key", "mark", F.sha2("text", 256).alias("digest"))
    groups = kept(digests.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last"), "copy-groups")
    copies = kept(digests.join(groups, "digest").where("key > first").select("key", "mark").distinct(), "copies")
    mine = candidates(rows, width, phrase).join(copies, ["key", "mark"], "left_anti")
    mine = kept(mine, "phrases")
    recurring = mine.groupBy("phrase").agg(F.min(F.struct("key", "mark")).alias("first"), F.max("key").alias("last")).where("first.key < last")
    owners = recurring.groupBy("first.key", "first.mark").agg(F.collect_list("phrase").alias("phrases"))
    words = kept(phrase_words(rows.select("key", "mark", "text").join(owners, ["key", "mark"]), width, phrase).dropDuplicates(["phrase"]), "phrase-words")
    lists = mine.join(words, "phrase").groupBy("key", "mark").agg(F.collect_list("words").alias("phrases"))
    windows = kept(located(rows.select("key", "text", "mark").join(lists, ["key", "mark"]), width, phrase), "windows")
    owners = kept(windows.groupBy("window").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("window", "first"), "owners")
    late = windows.join(owners, "window").where("key > first").groupBy("key", "mark").agg(F.collect_list("window").alias("windows"))
    verdicts = late.join(copies.withColumn("copy", F.lit(True)), ["key", "mark"], "full")
    return removed(rows.join(verdicts, ["key", "mark"], "left").select("key", "text", "windows", F.coalesce("copy", F.lit(False)), "doc_id"), width, docs.schema[id_col].dataType.simpleString(), keep_text)


#: The same result in DuckDB.
ORACLE = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (h) WHERE doc_id > first),
marked AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words),
rest AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.k) AS kept FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
