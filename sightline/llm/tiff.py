"""TIFF media columns: write, walk and decode, one row per page.

The reader walks the chain of image directories in either byte order, undoes
PackBits, LZW, deflate or no compression in strips and tiles, and undoes the
horizontal predictor.  Samples have 8 bits; a file or page outside that (or a
broken one) gives a row with ``error`` set instead of pixels.  The writer makes
multi-page grey images for tests and for storing byte payloads losslessly.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

# Fixed values of the TIFF 6.0 format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
TYPE_CODES = {1: "B", 3: "H", 4: "I"}

UNIT = 576
PAGE_ROWS = 64
PAGE_LIMIT_BYTES = 1 << 28


class TiffError(ValueError):
    pass


# --- codecs ---------------------------------------------------------------

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_row(row: bytes) -> bytes:
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            piece = row[k : min(b, k + 128)]
            out.append(bytes((len(piece) - 1,)) + piece)

    for m in _RUN.finditer(row):
        literal(at, m.start())
        out.append(bytes((257 - (m.end() - m.start()), row[m.start()])))
        at = m.end()
    literal(at, len(row))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, made, end = [], 0, 0, len(data)
    while at < end and made < size:
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            piece = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(piece)
        made += len(piece)
    return b"".join(out)


CLEAR, END, FULL = 256, 257, 3837  # codes between two clears when the table fills
# Width of the i-th code after a clear; it grows one code early.
_WIDTHS = np.full(FULL + 260, 12, np.int64)
_WIDTHS[:254], _WIDTHS[254:766], _WIDTHS[766:1790] = 9, 10, 11
_ENDS = np.concatenate(([0], np.cumsum(_WIDTHS)))
_BIT = np.arange(11, -1, -1)


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [CLEAR], [np.array([9])]
    since, table, free = 1, {}, 258
    if data:
        find, emit = table.get, codes.append
        held = data[0]
        for c in memoryview(data)[1:]:
            pair = held << 8 | c
            seen = find(pair)
            if seen is not None:
                held = seen
                continue
            emit(held)
            table[pair] = free
            held = c
            if free == 4094:
                emit(CLEAR)
                widths.append(_WIDTHS[: len(codes) - since])
                since = len(codes)
                table.clear()
                free = 258
            else:
                free += 1
        emit(held)
    codes.append(END)
    widths.append(_WIDTHS[: len(codes) - since])
    width = np.concatenate(widths)
    bits = (np.array(codes, np.int64)[:, None] >> _BIT) & 1
    return np.packbits(bits[_BIT < width[:, None]].astype(np.uint8)).tobytes()


_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    have = len(data) * 8
    out: list[bytes] = []
    emit, made, base = out.append, 0, 0
    while made < size:
        n = int(np.searchsorted(_ENDS, have - base, side="right")) - 1
        if n <= 0:
            break
        at, width = base + _ENDS[:n], _WIDTHS[:n]
        byte = at >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = ((window >> (24 - (at & 7) - width)) & ((1 << width) - 1)).tolist()
        table = _SINGLE.copy()
        grow, prev, used = table.append, b"", 0
        for code in codes:
            used += 1
            if code == CLEAR or code == END:
                break
            if not prev:
                if code > 255:
                    raise TiffError("LZW data starts with a table code")
                prev = _SINGLE[code]
            else:
                known = len(table)
                if code < known:
                    entry = table[code]
                elif code == known:
                    entry = prev + prev[:1]
                else:
                    raise TiffError("LZW code beyond the table")
                if known < 4096:
                    grow(prev + entry[:1])
                prev = entry
            emit(prev)
            made += len(prev)
        else:
            if n == len(_WIDTHS):
                raise TiffError("LZW table overflows without a clear code")
            break
        if code == END:
            break
        base += int(_ENDS[used])
    return b"".join(out)


def _compress(block: np.ndarray, codec: int) -> bytes:
    if codec == LZW:
        return lzw_encode(block.tobytes())
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(block.tobytes(), 6)
    if codec == PACKBITS:
        return b"".join(packbits_row(r.tobytes()) for r in block)
    return block.tobytes()


def _expand(data: bytes, codec: int, size: int) -> bytes:
    if codec == LZW:
        return lzw_decode(data, size)
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if codec == PACKBITS:
        return unpackbits(data, size)
    if codec == PLAIN:
        return data
    raise TiffError(f"compression {codec} is not supported")


# --- writer ---------------------------------------------------------------


def write_tiff(pages: list[dict]) -> bytes:
    """Pages: ``{"pixels": uint8[h, w], "codec": .., "predictor": 1|2, "rows_per_strip": n | "tile": (h, w)}``."""
    out, size, link = [b"II*\0" + bytes(4)], 8, 4
    links: list[tuple[int, int]] = []

    def put(piece: bytes) -> int:
        nonlocal size
        if size & 1:
            out.append(b"\0")
            size += 1
        at = size
        out.append(piece)
        size += len(piece)
        return at

    for page in pages:
        pixels, codec, predictor = page["pixels"], page["codec"], page.get("predictor", 1)
        h, w = pixels.shape
        th, tw = page.get("tile", (page.get("rows_per_strip", h), w))
        offsets, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = pixels[y : y + th, x : x + tw]
                if "tile" in page:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                piece = _compress(np.ascontiguousarray(block), codec)
                offsets.append(put(piece))
                counts.append(len(piece))
        tags = {WIDTH: [w], LENGTH: [h], BITS: [8], COMPRESSION: [codec], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tw], TILE_LENGTH: [th], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if "tile" in page else {ROWS_PER_STRIP: [th], STRIP_OFFSETS: offsets, STRIP_COUNTS: counts}
        entries = []
        for tag in sorted(tags):
            values = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            entries.append(struct.pack("<HHI", tag, 4, len(tags[tag])) + (values if len(values) == 4 else struct.pack("<I", put(values))))
        at = put(struct.pack("<H", len(entries)) + b"".join(entries) + bytes(4))
        links.append((link, at))
        link = at + 2 + 12 * len(entries)
    whole = bytearray(b"".join(out))
    for where, at in links:
        struct.pack_into("<I", whole, where, at)
    return bytes(whole)


# --- reader ---------------------------------------------------------------


def _directories(data: bytes):
    if data[:4] == b"II*\0":
        order = "<"
    elif data[:4] == b"MM\0*":
        order = ">"
    else:
        raise TiffError("not a TIFF file")
    seen, (at,) = set(), struct.unpack_from(order + "I", data, 4)
    while at:
        if at in seen:
            raise TiffError("image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind in TYPE_CODES:
                form = f"{order}{count}{TYPE_CODES[kind]}"
                where = entry + 8
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(form, data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict) -> dict:
    def one(tag: int, default=None):
        if tag in tags and tags[tag]:
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    w, h, samples, codec, predictor = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))):
        raise TiffError("samples don't have 8 bits")
    if one(PLANAR, 1) != 1 and samples > 1:
        raise TiffError("planes are stored apart")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not supported")
    if w * h * samples > PAGE_LIMIT_BYTES:
        raise TiffError("page is too large")
    tiled = TILE_OFFSETS in tags
    th, tw = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if min(w, h, th, tw) <= 0:
        raise TiffError("a side is 0")
    pixels = np.zeros((h, w, samples), np.uint8)
    k = 0
    for y in range(0, h, th):
        for x in range(0, w, tw):
            rows = th if tiled else min(th, h - y)
            if k >= len(offsets):
                raise TiffError("strips or tiles are missing")
            raw = _expand(data[offsets[k] : offsets[k] + counts[k]], codec, rows * tw * samples)
            if len(raw) < rows * tw * samples:
                raise TiffError("a strip or tile is too short")
            block = np.frombuffer(raw, np.uint8, rows * tw * samples).reshape(rows, tw, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            part = pixels[y : y + rows, x : x + tw]
            part[:] = block[: part.shape[0], : part.shape[1]]
            k += 1
    return {"width": w, "height": h, "samples": samples, "codec": NAMES.get(codec, str(codec)), "predictor": predictor, "tiled": tiled, "pixels": pixels.tobytes(), "error": None}


def read_tiff(data: bytes):
    """Yield a dict per page; the first problem ends the file with a dict that has ``error``."""
    blank = {"width": None, "height": None, "samples": None, "codec": None, "predictor": None, "tiled": None, "pixels": None}
    try:
        for tags in _directories(data):
            try:
                yield _page(data, tags)
            except (TiffError, struct.error, zlib.error, KeyError, IndexError) as e:
                yield blank | {"error": str(e)}
    except (TiffError, struct.error, IndexError) as e:
        yield blank | {"error": str(e)}


# --- operators ------------------------------------------------------------

PAGE_SCHEMA = "page_no int, width int, height int, samples int, codec string, predictor int, tiled boolean, pixels binary, error string"
_PAGE_ARROW = [("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("codec", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]


def tiff_pages(media: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per page: the other columns of ``media`` plus ``PAGE_SCHEMA``.

    Pages of a file follow one another, numbered from 0, inside one partition.  Null
    content gives no page; empty or broken content gives one row with ``error``, and so does
    a page that isn't of 8-bit samples in one plane or has more than ``PAGE_LIMIT_BYTES``
    (a page is one cell of a column, and a directory may claim any size); the file's
    other pages are read.  Very long files are read whole; repeated rows give their
    pages each; an empty table gives an empty one.  Columns of ``media`` named like the
    page columns are replaced.
    """
    ours = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
    keep = [c for c in media.columns if c not in ours and c != content_col]
    rows = media.select(F.col(content_col).alias("__sl_content"), *keep)

    def decode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                piece = batch.slice(at, 32)
                owner, numbers, pages = [], [], []
                for k, data in enumerate(piece.column(0)):
                    if data.is_valid:
                        for n, page in enumerate(read_tiff(data.as_py())):
                            owner.append(k)
                            numbers.append(n)
                            pages.append(page)
                kept = [piece.column(i + 1).take(pa.array(owner, pa.int64())) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), *(pa.array([p[n] for p in pages], t) for n, t in _PAGE_ARROW)], names=keep + ours)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(decode, f"{kinds}, {PAGE_SCHEMA}" if kinds else PAGE_SCHEMA)


#: How pages of a payload are stored, in turn.
STYLES = (
    {"codec": DEFLATE, "predictor": 2, "tile": (64, 192)},
    {"codec": PACKBITS, "rows_per_strip": 16},
    {"codec": LZW, "predictor": 1, "rows_per_strip": 32},
)


def payload_tiff(payload: bytes, unit: int = UNIT, page_rows: int = PAGE_ROWS) -> bytes:
    """The payload, a multiple of ``unit`` bytes, as grey pages ``unit`` pixels wide."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, unit)
    return write_tiff([STYLES[(len(pixels) + k) % len(STYLES)] | {"pixels": pixels[y : y + page_rows]} for k, y in enumerate(range(0, len(pixels), page_rows))])


def text_media(docs: DataFrame, text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``n_bytes`` and ``content``, a TIFF of its padded UTF-8 bytes.

    Null and empty texts become one row of padding; a very long text has as many pages
    as it needs (up to 2 GB, the size of a cell); equal texts get equal files; repeated
    rows are stored each; an empty table gives an empty one.  Columns named
    ``n_bytes`` or ``content`` are replaced, the others pass through.
    """
    keep = [c for c in docs.columns if c not in (text_col, "n_bytes", "content")]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__sl_text"), *keep)

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                texts = piece.column(0).to_pylist()
                made = [payload_tiff(t + b"\xff" * (-len(t) % unit if t else unit), unit) for t in texts]
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary())], names=[*keep, "n_bytes", "content"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(encode, f"{kinds}, n_bytes long, content binary")


def feature_of(pixels: np.ndarray, pages: int) -> str:
    """Rows, pages, mean, coarse histogram and an 8x8 mean hash of all pixel rows."""
    flat = pixels.reshape(-1)
    histogram = np.bincount(flat >> 5, minlength=8)
    means = np.add.reduceat(flat.astype(np.int64), np.arange(64) * len(flat) // 64)
    bits = int("".join("1" if m * 64 > means.sum() else "0" for m in means.tolist()), 2)
    return f"rows={len(pixels)};pages={pages};mean={flat.mean():.3f};hist={','.join(map(str, histogram.tolist()))};hash={bits:016x}"


def page_digests(pages: DataFrame, keep: list[str], unit: int = UNIT) -> DataFrame:
    """One row per file from its page rows: digests of the pixels in page order and features.

    ``pages`` comes as ``tiff_pages`` gives it: a file's pages in order, page 0 first, in one
    partition.  A file with an ``error`` on any page, or without pixels, has null digests;
    a file without pages (null content) has no row; files equal in ``keep`` have a row
    each; an empty table gives an empty one; columns outside ``keep`` are ignored.
    """

    def close(state, out):
        owner, pixels, n, error = state
        data = b"".join(pixels)
        good = not error and data
        out.append([*owner, len(data) if good else None, hashlib.sha256(data).hexdigest() if good else None, zlib.crc32(data[-32:]) if good else None, feature_of(np.frombuffer(data, np.uint8).reshape(-1, unit), n) if good else None])

    def fold(batches):
        state, kinds = None, None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in keep]
            out: list[list] = []
            columns = [batch.column(c).to_pylist() for c in (*keep, "page_no", "pixels", "error")]
            for *owner, number, pixels, error in zip(*columns):
                if number == 0:
                    if state:
                        close(state, out)
                    state = [owner, [], 0, None]
                state[1].append(pixels or b"")
                state[2] += 1
                state[3] = state[3] or error
            if out:
                yield table(out, kinds)
        if state:
            out = []
            close(state, out)
            yield table(out, kinds)

    def table(out, kinds):
        types = [*kinds, pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "page_no", "pixels", "error").mapInArrow(fold, f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op1_tiff_pages(spark, sf_dir: str) -> DataFrame:
    media = text_media(documents(spark, sf_dir).select("doc_id", "text"))
    media = media.withColumns({"media_bytes": F.octet_length("content").cast("long"), "media_sha256": F.sha2("content", 256)})
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    out = page_digests(tiff_pages(media), keep)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
