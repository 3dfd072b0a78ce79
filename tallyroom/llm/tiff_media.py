"""TIFF as a column: writing byte payloads as images, and reading the pages of any TIFF.

The reader walks the image directories (classic and big files, either byte order), decodes strips or
tiles (raw, PackBits, LZW, deflate), undoes the horizontal and floating-point predictors, and gives one row per page.
A damaged file gives a row with an error for the page it broke at; a directory that points back ends the walk.

Nulls are empty payloads on writing and no pages on reading.  Everything is row by row: no shuffle, one file in
memory at a time.

Repeated rows give repeated rows, equal texts equal files; very long texts are stored whole, an empty table gives an empty table, and
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import lean

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 16_384, 1_024
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Sizes of the field types by number.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128 and i < n:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, each width left one code early."""
    table: list[bytes] = []
    out: list[bytes] = []
    acc = bits = at = 0
    width, last = 9, b""
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table = list(fresh)
    n = len(data)
    while True:
        while bits < width and at < n:
            acc = acc << 8 | data[at]
            at += 1
            bits += 8
        if bits < width:
            break
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a code before its entry")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    size, width, held = 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        put(table[held], width)
        table[longer] = size
        size += 1
        held = data[i : i + 1]
        if size == 4094:
            put(256, width)
            table = {bytes((j,)): j for j in range(256)}
            size, width = 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    if held:
        put(table[held], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def pack(data: bytes, compression: int) -> bytes:
    if compression == RAW:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"no compression {compression}")


def write(samples: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, compression: int = DEFLATE, predictor: int = 2) -> bytes:
    """Grey 8-bit pages of ``width`` columns; the length of ``samples`` is a multiple of ``width``."""
    rows = len(samples) // width
    if rows * width != len(samples):
        raise ValueError("rows are not full")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, max(rows, 1), page_rows):
        grid = np.frombuffer(samples, np.uint8, min(page_rows, rows - top) * width, top * width).reshape(-1, width)
        if predictor == 2:
            grid = np.concatenate([grid[:, :1], np.diff(grid, axis=1)], axis=1)
        strips = [pack(grid[i : i + strip_rows].tobytes(), compression) for i in range(0, len(grid), strip_rows)] or [b""]
        offsets = []
        for s in strips:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        n = len(strips)
        lists = len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *offsets, *map(len, strips))
        fields = [(256, 4, 1, width), (257, 4, 1, len(grid)), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, n, lists if n > 1 else offsets[0]), (277, 3, 1, 1), (278, 4, 1, strip_rows), (279, 4, n, lists + 4 * n if n > 1 else len(strips[0])), (317, 3, 1, predictor)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 1
    compression: int = RAW
    tiled: bool = False
    pixels: bytes = b""
    error: str | None = None


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """``block``: rows, columns, samples."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        size = block.dtype.itemsize
        rows, columns, samples = block.shape
        raw = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, columns * size, samples), axis=1, dtype=np.uint8)
        planes = raw.reshape(rows, size, columns, samples)[:, :: 1 if order == ">" else -1]
        return np.ascontiguousarray(planes.transpose(0, 2, 3, 1)).reshape(rows, columns, samples * size).view(block.dtype)
    return block


def _read_page(data: bytes, tags: dict[int, tuple], page: Page, order: str) -> None:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    page.width, page.height, page.samples, page.compression = one(256, 0), one(257, 0), one(277, 1), one(259, RAW)
    page.bits, predictor, planar = one(258, 1), one(317, 1), one(284, 1)
    page.tiled = 322 in tags
    if page.tiled:
        columns, rows, offsets, counts = one(322, 0), one(323, 0), tags.get(324, ()), tags.get(325, ())
    else:
        columns, rows = page.width, min(one(278, page.height) or page.height, page.height)
        offsets = tags.get(273, ())
        counts = tags.get(279) or (len(data),) * len(offsets)
    planes, inner = (page.samples, 1) if planar == 2 else (1, page.samples)
    if not (page.width and page.height and rows and columns):
        raise ValueError("no size")
    if page.width * page.height * page.samples * page.bits > 1 << 33:
        raise ValueError("too large")
    across, down = -(-page.width // columns), -(-page.height // rows)
    wide = page.bits >= 8
    dtype = np.dtype(f"{order}u{page.bits // 8}") if page.bits in (8, 16, 32, 64) else np.dtype("u1")
    if page.bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"no samples of {page.bits} bits")
    whole = np.zeros((page.height, page.width, page.samples), dtype)
    for k in range(planes * across * down):
        if k >= len(offsets):
            raise ValueError("a strip or tile is missing")
        plane, rest = divmod(k, across * down)
        y, x = (rest // across) * rows, (rest % across) * columns
        height = rows if page.tiled else min(rows, page.height - y)
        line = -(-columns * inner * page.bits // 8)
        raw = unpack(data[offsets[k] : offsets[k] + counts[k]], page.compression, line * height)[: line * height]
        if len(raw) < line * height:
            raise ValueError("a strip or tile is short")
        if wide:
            block = np.frombuffer(raw, dtype).reshape(height, columns, inner)
        else:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(height, line), axis=1)[:, : columns * inner * page.bits]
            block = (bits.reshape(height, columns, inner, page.bits) << np.arange(page.bits - 1, -1, -1, dtype=np.uint8)).sum(3, dtype=np.uint8)
        block = _undo(block, predictor, order)[: page.height - y, : page.width - x]
        part = slice(plane, plane + 1) if planes > 1 else slice(None)
        whole[y : y + block.shape[0], x : x + block.shape[1], part] = block
    page.pixels = whole.tobytes()


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    number = 0
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        version = struct.unpack_from(order + "H", data, 2)[0]
        big = version == 43
        if version not in (42, 43):
            raise ValueError("no such version")
        at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
        seen: set[int] = set()
        entry, slot = (20, 8) if big else (12, 4)
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            at += 8 if big else 2
            page, tags = Page(number), {}
            try:
                for i in range(n):
                    tag, kind = struct.unpack_from(order + "HH", data, at + i * entry)
                    count = struct.unpack_from(order + ("Q" if big else "I"), data, at + i * entry + 4)[0]
                    if kind not in CODES:
                        continue
                    place = at + (i + 1) * entry - slot
                    if count * SIZES[kind] > slot:
                        place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
                    if count > len(data):
                        raise ValueError("a field is longer than the file")
                    tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place)
                _read_page(data, tags, page, order)
            except (ValueError, IndexError, struct.error, zlib.error) as error:
                page.error = str(error) or type(error).__name__
            yield page
            number += 1
            at = struct.unpack_from(order + ("Q" if big else "I"), data, at + n * entry)[0]
    except (ValueError, KeyError, struct.error) as error:
        yield Page(number, error=f"{type(error).__name__}: {error}")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a TIFF."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for x in batch.column(1):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                sizes.append(len(raw))
                media.append(write(raw + b"\0" * (max(-len(raw) % 64, 64 * (not raw)))))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, n_bytes long, media binary")


def pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, compression, tiled, pixels, error."""
    id_type = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                found = list(read(x.as_buffer().to_pybytes())) if x.is_valid else []
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "id": batch.column(0).take(pa.array([i] * len(found))),
                        **{k: pa.array([getattr(p, k if k != "page" else "number") for p in found], t) for k, t in (("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string()))},
                    })

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(lean(run), f"id {id_type}, page int, width long, height long, samples int, bits int, compression int, tiled boolean, pixels binary, error string")


def digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """One row per file: what its pages hold together, read back from the stored bytes."""
    id_type = media.schema[id_col].dataType.simpleString()
    rest = [(c, media.schema[c].dataType.simpleString()) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                found = list(read(raw)) if raw else []
                payload = b"".join(p.pixels for p in found)
                grey = np.frombuffer(payload, np.uint8)
                counts = np.bincount(grey, minlength=256)
                chance = counts[counts > 0] / max(len(grey), 1)
                feature = f"pages={len(found)};width={max((p.width for p in found), default=0)};height={sum(p.height for p in found)};mean={float(grey.mean()) if len(grey) else 0:.3f};entropy={float(-(chance * np.log2(chance)).sum()) if len(chance) else 0:.3f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, next((p.error for p in found if p.error), None)))
            kinds = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{c: batch.column(2 + i) for i, (c, _) in enumerate(rest)}, **{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)}})

    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"), *carry).mapInArrow(lean(run), f"doc_id {id_type}, {''.join(f'{c} {t}, ' for c, t in rest)}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
