"""Token ids as binary shards, coded by a static range asymmetric numeral system.

Shard format (little-endian), one shard per about ``shard_tokens`` ids (a slice of texts is never split)::

    "TRNS" u16 version  u16 lanes  u8 scale_bits  u32 tokens  u32 block_tokens  u32 symbols  u32 documents
    symbols x (u32 symbol, u32 frequency)            one table, shared by all blocks of the shard
    documents x u32 tokens                           which sum up to those of the shard
    for each block:
        u32 tokens  u32 crc32 of its ids  u32 checkpoints
        checkpoints x lanes x u64 state, checkpoints x lanes x u32 words still unread
        lanes x u32 words  and the words (u32) of each lane

Ids of a block go to its lanes in turn.  A lane is a coder of its own with a 64-bit state; blocks are
independent, so any number of them decode in parallel, and inside a block decoding may begin at a
checkpoint.  The first checkpoint is the block's beginning.  Lanes of all blocks of a shard advance together
in array operations.

Frequencies sum to ``2**scale_bits``; every symbol that occurs has at least one.

Ids of texts come from the tokenizers library.  White space always ends a pre-token there, so the ids of a text are those of its chunks;
of a chunk of Latin letters (below U+0100) and trailing marks the marks are a pre-token of their own, and case does not matter.  So only distinct
pieces are tokenised: they are found by Arrow, and a worker remembers up to ``PIECES`` of them, which changes no result.

A null or empty text holds the end id alone.  Repeated rows are documents of their own.  A null id comes first, equal ids are ordered by a hash of
their text and then by the text.  Very long texts are never split, so that a shard may be larger than ``shard_tokens``; an empty table gives
no shards.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import lean, ragged, remembered
from tallyroom.llm.chunks import Cache, coded
from tallyroom.llm.tables import kept

MAGIC, VERSION = b"TRNS", 2
LANES, SCALE_BITS, BLOCK_TOKENS, CHECKPOINT_STEPS = 32, 20, 32_768, 512
SHARD_TOKENS = 2_000_000
PIECES, PIECES_AT_ONCE = 600_000, 2_000
LOW = np.uint64(1 << 31)  # states are in [2**31, 2**63)
HEAD = struct.Struct("<4sHHBIIII")
BLOCK = struct.Struct("<III")
U32 = np.uint64(32)


def frequencies(ids: np.ndarray, scale_bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in ascending order and their scaled counts.  Rounding errors go to the commonest symbols."""
    counts = np.bincount(ids) if len(ids) and int(ids.max()) < 1 << 24 else None
    if counts is None:
        symbols, counts = np.unique(ids, return_counts=True)
    else:
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    total = 1 << scale_bits
    if len(symbols) > total:
        raise ValueError("more symbols than the scale has room for")
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.int64)
    scaled = np.maximum(1, counts * total // counts.sum())
    order = np.argsort(-counts, kind="stable")
    over = int(scaled.sum()) - total
    if over < 0:
        scaled[order[0]] -= over
    for i in order if over > 0 else ():
        take = min(over, int(scaled[i]) - 1)
        scaled[i] -= take
        over -= take
        if not over:
            break
    return symbols.astype(np.uint32), scaled


def encode_shard(ids: np.ndarray, counts: np.ndarray | None = None, lanes: int = LANES, block_tokens: int = BLOCK_TOKENS, scale_bits: int = SCALE_BITS, checkpoint_steps: int = CHECKPOINT_STEPS) -> bytes:
    """A shard of documents of ``counts`` ids each (one document, if not given)."""
    ids = np.asarray(ids, np.uint32)
    counts = np.array([len(ids)] if counts is None else counts)
    if counts.sum() != len(ids):
        raise ValueError("the documents do not make up the ids")
    symbols, freq = frequencies(ids, scale_bits)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.empty(0, np.uint64)
    freq = freq.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // block_tokens)
    steps = -(-block_tokens // lanes)
    place = np.zeros(blocks * block_tokens, np.int32)
    if n and symbols[-1] < 1 << 24:
        rank = np.zeros(int(symbols[-1]) + 1, np.int32)
        rank[symbols] = np.arange(len(symbols), dtype=np.int32)
        place[:n] = rank[ids]
    elif n:
        place[:n] = np.searchsorted(symbols, ids)
    used = np.zeros(blocks * block_tokens, bool)
    used[:n] = True
    wide = blocks * lanes
    # row s holds the s-th id of every lane of every block
    place = place.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, wide)
    used = used.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, wide)
    state = np.full(wide, LOW, np.uint64)
    words = np.zeros((steps, wide), np.uint32)
    gave = np.zeros((steps, wide), bool)
    unread = np.zeros(wide, np.uint32)
    marks, shift = [], np.uint64(scale_bits)
    limit = np.uint64((1 << 63) >> scale_bits)
    for s in range(steps - 1, -1, -1):  # the decoder runs forward, so the encoder runs backward
        f, c = freq[place[s]], start[place[s]]
        live = used[s]
        out = live & (state >= f * limit)
        words[s], gave[s] = state, out
        unread += out
        x = np.where(out, state >> U32, state)
        q = x // f
        state = np.where(live, (q << shift) + (x - q * f) + c, state)
        if s % checkpoint_steps == 0:
            marks.append((state.copy(), unread.copy()))
    marks.reverse()
    head = [HEAD.pack(MAGIC, VERSION, lanes, scale_bits, n, block_tokens, len(symbols), len(counts)), np.column_stack([symbols, freq.astype(np.uint32)]).astype("<u4").tobytes(), counts.astype("<u4").tobytes()]
    for b in range(blocks):
        at = slice(b * lanes, (b + 1) * lanes)
        own = ids[b * block_tokens : (b + 1) * block_tokens]
        took = gave[:, at].T
        head += [
            BLOCK.pack(len(own), zlib.crc32(own.astype("<u4").tobytes()), len(marks)),
            np.stack([m[0][at] for m in marks]).astype("<u8").tobytes(),
            np.stack([m[1][at] for m in marks]).astype("<u4").tobytes(),
            took.sum(1).astype("<u4").tobytes(),
            words[:, at].T[took].astype("<u4").tobytes(),
        ]
    return b"".join(head)


class Shard:
    """A shard's table and blocks, unparsed until decoded."""

    def __init__(self, raw: bytes):
        magic, version, self.lanes, self.scale_bits, self.tokens, self.block_tokens, n, documents = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        table = np.frombuffer(raw, "<u4", 2 * n, HEAD.size).reshape(n, 2)
        self.symbols, self.freq = table[:, 0].astype(np.uint32), table[:, 1].astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(n, dtype=np.int32), self.freq.astype(np.int64))
        self.counts = np.frombuffer(raw, "<u4", documents, HEAD.size + 8 * n).astype(np.int64)
        if self.counts.sum() != self.tokens:
            raise ValueError("the documents do not make up the ids")
        self.blocks, at = [], HEAD.size + 8 * n + 4 * documents
        while at < len(raw):
            size, crc, marks = BLOCK.unpack_from(raw, at)
            at += BLOCK.size
            states = np.frombuffer(raw, "<u8", marks * self.lanes, at).reshape(marks, self.lanes)
            at += 8 * states.size
            unread = np.frombuffer(raw, "<u4", marks * self.lanes, at).reshape(marks, self.lanes)
            at += 4 * unread.size
            counts = np.frombuffer(raw, "<u4", self.lanes, at).astype(np.int64)
            at += 4 * self.lanes
            words = np.frombuffer(raw, "<u4", int(counts.sum()), at)
            at += 4 * len(words)
            self.blocks.append((size, crc, states, unread, counts, words))

    def decode(self, first: int = 0, last: int | None = None, checkpoint: int = 0, checkpoint_steps: int = CHECKPOINT_STEPS) -> np.ndarray:
        """Ids of blocks first..last (exclusive); with ``checkpoint``, of one block from there on.  Whole
        blocks are held against their checksums."""
        chosen = self.blocks[first:last]
        if not chosen:
            return np.empty(0, np.uint32)
        if checkpoint and len(chosen) > 1:
            raise ValueError("a checkpoint is one block's")
        steps, wide = -(-self.block_tokens // self.lanes), len(chosen) * self.lanes
        words = np.concatenate([np.concatenate([b[5] for b in chosen]), np.zeros(1, np.uint32)]).astype(np.uint64)
        ends = np.cumsum(np.concatenate([b[4] for b in chosen]))
        at = ends - np.concatenate([b[3][checkpoint] for b in chosen]).astype(np.int64)
        state = np.concatenate([b[2][checkpoint] for b in chosen]).astype(np.uint64)
        sizes = np.repeat([b[0] for b in chosen], self.lanes)
        lane = np.tile(np.arange(self.lanes), len(chosen))
        begin = checkpoint * checkpoint_steps
        out = np.zeros((steps - begin, wide), np.int32)
        mask, shift = np.uint64((1 << self.scale_bits) - 1), np.uint64(self.scale_bits)
        shortest = min(b[0] for b in chosen)
        for s in range(begin, steps):
            if s * self.lanes >= sizes.max():
                break
            low = state & mask
            sym = self.slot[low.astype(np.int64)]
            x = self.freq[sym] * (state >> shift) + low - self.start[sym]
            need = x < LOW
            if (s + 1) * self.lanes > shortest:
                live = s * self.lanes + lane < sizes
                x, need = np.where(live, x, state), need & live
            state = np.where(need, (x << U32) | words[np.minimum(at, len(words) - 1)], x)
            at += need
            out[s - begin] = sym
        grid = out.reshape(steps - begin, len(chosen), self.lanes).transpose(1, 0, 2).reshape(len(chosen), -1)
        parts = []
        for row, (size, crc, *_) in zip(grid, chosen):
            ids = self.symbols[row[: size - begin * self.lanes]]
            if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum does not fit")
            parts.append(ids)
        return np.concatenate(parts)


class Pieces:
    """Ids of chunks by the tokenizers library."""

    MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.cache = Cache(self.work, np.uint32, PIECES)

    def work(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, many at once with a special token between, which cuts what stands around it."""
        mark, cut = next(iter(self.special.items()), ("", -1))
        plain = [p for p in pieces if not any(t in p for t in self.special)] if mark else []
        flat, sizes = [], {}
        for i in range(0, len(plain), PIECES_AT_ONCE):
            some = plain[i : i + PIECES_AT_ONCE]
            (said,) = self.tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)
            ids = np.array(said.ids, np.uint32)
            ends = np.concatenate([np.flatnonzero(ids == cut), [len(ids)]])
            flat.append(ids[ids != cut])
            sizes.update(zip(some, np.diff(ends, prepend=-1) - 1))
        if len(plain) == len(pieces):
            return (np.concatenate(flat) if flat else np.empty(0, np.uint32)), np.array([sizes[p] for p in pieces], np.int64)
        own = dict(zip(plain, np.split(np.concatenate(flat), np.cumsum([sizes[p] for p in plain])[:-1]))) if plain else {}
        rows = [own[p] if p in own else np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces]
        return np.concatenate(rows).astype(np.uint32), np.array([len(r) for r in rows], np.int64)

    def expand(self, chunks: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the sequence ``codes`` of distinct chunks, and how many each gave."""
        if not len(chunks):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lower = pc.utf8_lower(chunks)
        core = pc.ascii_rtrim(lower, self.MARKS)
        cut = pc.and_(pc.match_substring_regex(chunks, r"^[\x00-{}-\x{ff}]+$"), pc.match_substring_regex(core, "[a-zß-öø-ÿ]$"))  # Latin letters, no |
        core, tail = pc.if_else(cut, core, chunks), pc.if_else(cut, pc.replace_substring_regex(lower, "^.*[a-zß-öø-ÿ]", ""), "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        at = self.cache.places(both.dictionary.to_numpy(zero_copy_only=False).tolist())[both.indices.to_numpy(zero_copy_only=False)]
        at = at.reshape(2, -1).T.ravel()  # core and tail of each chunk in turn
        starts, counts = self.cache.table.offsets[at], np.diff(self.cache.table.offsets)[at]
        ids = self.cache.table.flat[ragged(starts, counts)]
        sizes = counts.reshape(-1, 2).sum(1)
        return ids[ragged((np.cumsum(sizes) - sizes)[codes], sizes[codes])], sizes[codes]


def _pieces(path: str) -> Pieces:
    return remembered(__name__, path, lambda: Pieces(path))


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards in ascending order of the ids of documents: one row per shard with part, shard (its place in
    the part), doc_ids, tokens (how many ids it holds), and payload in the format above.

    Documents are range-partitioned by id and a hash of the text and sorted inside a partition, so parts follow each other and
    neither null ids nor an id that many rows share make one task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, k = _pieces(path), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, doc_ids, held, counts, size
            payload = encode_shard(np.concatenate(held), np.concatenate(counts))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "doc_ids": pa.array([doc_ids], kind), "tokens": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})
            k, doc_ids, held, counts, size = k + 1, [], [], [], 0
            return row

        kind = None
        for batch in batches:
            kind = pa.list_(batch.schema.field(0).type)
            for lo, hi, at, codes, chunks in coded(batch.column(1)):
                ids, per_chunk = pieces.expand(chunks, codes)
                ends = np.concatenate([[0], np.cumsum(per_chunk)])[at]
                n = np.diff(ends) + 1
                flat = np.full(int(n.sum()), end_id, np.uint32)
                flat[ragged(np.cumsum(n) - n, n - 1)] = ids
                doc_ids += batch.column(0)[lo:hi].to_pylist()
                held.append(flat)
                counts.append(n)
                size += len(flat)
                if size >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("mark"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return dealt.mapInArrow(lean(run), f"shard int, doc_ids array<{id_type}>, tokens long, payload binary").withColumn("part", F.spark_partition_id())


def write_shards(shards: DataFrame) -> DataFrame:
    """The shards as a table in the shared folder, read again; ``start`` counts the ids in all shards before.

    Two sums give it: inside a part over its few shards, and over parts on the driver, which gets one number
    a part, never one a document."""
    table = kept(shards, "token-shards")
    sizes = table.select("part", "shard", F.col("tokens").alias("n"))
    parts = pd.DataFrame(sizes.groupBy("part").agg(F.sum("n").alias("n")).collect(), columns=["part", "n"]).sort_values("part")
    parts["before"] = parts["n"].cumsum() - parts["n"]
    before = table.sparkSession.createDataFrame([(int(p), int(b)) for p, b in zip(parts["part"], parts["before"])] or [(0, 0)], "part int, before long")
    from pyspark.sql import Window

    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(before), "part").select("part", "shard", (F.col("own") + F.col("before")).alias("start"))
    return table.join(starts, ["part", "shard"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Decodes shards: one row per document with doc_id, start, n_tokens and ids' crc32, all but the first from the shard's bytes."""
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                ids, n, names = shard.decode(), shard.counts, batch.column(1)[row].values
                if len(ids) != shard.tokens or len(names) != len(n):
                    raise ValueError("a shard does not hold what it should")
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": names,
                    "start": batch.column(0)[row].as_py() + ends - n,
                    "n_tokens": n,
                    "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])],
                })

    return shards.select("start", "doc_ids", "payload").mapInArrow(lean(run), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
