"""BPE encoding and decoding.

A pre-token becomes a doubly linked list of symbols; a priority queue holds the merges its neighbours
allow, lowest rank first and leftmost among equals.  A merge rewires the list and queues what its two new
neighbourhoods allow; queue entries whose pair no longer stands are skipped.  Decoding concatenates
vocabulary strings.  The file is a tokenizer description in JSON; its path is a parameter.

Nulls and empty texts encode to no ids and decode to an empty text.  Very long texts are worked on whole; of pairs of equal rank the
leftmost merges first.  Repeated rows give repeated rows, empty tables empty ones.  The input may have any other columns, whatever their
names; only the two named are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import lean, remembered
from tallyroom.llm.chunks import Cache, chunked


#: Bounds of what a worker remembers (chunks and pre-tokens), and of the text it works on at once.
CHUNKS, PRETOKENS, SLICE_BYTES = 200_000, 150_000, 2 << 20
#: The last letter whose class and case are the same in all editions of Unicode in use.
LATIN = "\u024f"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairs:
    """Encoder and decoder of one description file."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in told.get("added_tokens") or []}
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for text, i in [*self.vocab.items(), *self.added.items()]:
            self.strings[i] = text
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.steps = self._normalizers(told.get("normalizer"))
        kinds = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [told["pre_tokenizer"]]
        self.split = next((regex.compile(x["pattern"]["Regex"]) for x in kinds if x["type"] == "Split"), None)
        self.letters = byte_letters()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}  # packed ids of pre-tokens

    @staticmethod
    def _normalizers(told: dict | None) -> list:
        def lower(text: str) -> str:
            return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

        def step(x: dict):
            if x["type"] == "NFC":
                return lambda s: s if s.isascii() else unicodedata.normalize("NFC", s)
            if x["type"] == "Replace":
                rule, put = regex.compile(x["pattern"]["Regex"]), x["content"]
                return lambda s: rule.sub(put, s)
            if x["type"] == "Lowercase":
                return lower
            raise ValueError(f"no normalizer {x['type']}")

        return [step(x) for x in (told or {}).get("normalizers") or ([told] if told else [])]

    def merge(self, letters: list[str]) -> list[int]:
        """Ids of one pre-token, given as the letters of its bytes."""
        letters[-1] += self.suffix
        ids = [self.vocab[x] for x in letters if x in self.vocab]
        n = len(ids)
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        find, queue = self.merges.get, []
        for i in range(n - 1):
            if (m := find((ids[i], ids[i + 1]))) is not None:
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, made = heapq.heappop(queue)
            j = right[i]
            if ids[i] < 0 or j < 0 or (m := find((ids[i], ids[j]))) is None or m[1] != made:
                continue  # stale: one of its symbols has gone or changed
            ids[i], ids[j] = made, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (m := find((made, ids[k]))) is not None:
                    heapq.heappush(queue, (m[0], i, m[1]))
            if (h := left[i]) >= 0 and (m := find((ids[h], made))) is not None:
                heapq.heappush(queue, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        if max(text, default="") > LATIN:
            return self._cut_by_library(text)
        for f in self.steps:
            text = f(text)
        out: list[bytes] = []
        if len(self.known) > PRETOKENS:
            self.known.clear()
        for m in self.split.finditer(text) if self.split else [text]:
            token = m if isinstance(m, str) else m[0]
            if (ids := self.known.get(token)) is None:
                ids = self.known[token] = array("I", self.merge([self.letters[b] for b in token.encode()])).tobytes()
            out.append(ids)
        return b"".join(out)

    def _cut_by_library(self, text: str) -> bytes:
        """As above, for texts beyond Latin letters: what is a letter there depends on the edition of Unicode, so the library says
        where pre-tokens begin; it gives them as letters of bytes."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return b"".join(array("I", self.merge(list(token))).tobytes() for token, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(array("I", [self.added[x]]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        """Vocabulary strings, one space between them, as the library joins them without a decoder."""
        return " ".join(self.strings[i] for i in ids)


def codec(path: str) -> BytePairs:
    return remembered(__name__, ("codec", path), lambda: BytePairs(path))


def _cache(path: str) -> Cache:
    coder = codec(path)
    return remembered(__name__, ("chunks", path), lambda: Cache(lambda chunks: [coder.packed(c) for c in chunks], np.uint32, CHUNKS))


def _strings(path: str) -> pa.Array:
    return remembered(__name__, ("strings", path), lambda: pa.array(codec(path).strings, pa.string()))


def encoded(path: str, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of texts: lo, hi, ids of all of them, offsets of each text's ids."""
    cache = _cache(path)
    for lo, hi, at, codes, chunks in chunked(col, SLICE_BYTES):
        ids, counts = cache.expand(chunks, codes)
        run = np.concatenate([[0], np.cumsum(counts)])
        yield lo, hi, ids, run[at]


def decoded(path: str, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    strings = _strings(path).take(pa.array(ids.astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings), " ")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, keep: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (array<int>) and decoded text if ``keep``, n_tokens, and SHA-256 of
    both.  Works row by row: no shuffle, nothing kept between rows but a bounded cache of chunks."""
    kind = "ids array<int>, decoded string, " if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, at in encoded(path, batch.column(1)):
                raw, cuts = memoryview(ids.astype("<u4").tobytes()), (4 * at).tolist()
                back = decoded(path, ids, at)
                cols = {"doc_id": batch.column(0)[lo:hi]}
                if keep:
                    cols |= {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), "decoded": back}
                cols |= {
                    "n_tokens": pa.array(np.diff(at)),
                    "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])],
                    "decoded_sha256": [hashlib.sha256(x.as_buffer()).hexdigest() for x in back],
                }
                yield pa.RecordBatch.from_pydict(cols)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, {kind}n_tokens long, ids_sha256 string, decoded_sha256 string")
