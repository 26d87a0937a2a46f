"""TIFF as a media column: image directories are walked, strips or tiles decoded, predictors undone; a row per page.

Bit depths of 8 and 16, grey or several samples, both byte orders, compressions none, LZW, deflate and PackBits,
predictors none and horizontal. The writer makes the same forms.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

# Fixed values of the format: tags, field sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257


_REPEATED = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(raw: bytes) -> bytes:
    """Three and more equal bytes as a count and the byte, what stands between as it is, in lots of at most 128."""
    out, at = bytearray(), 0

    def plain(end):
        for i in range(at, end, 128):
            part = raw[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _REPEATED.finditer(raw):
        plain(m.start())
        out += bytes((257 - len(m[0]), m[0][0]))
        at = m.end()
    plain(len(raw))
    return bytes(out)


def packbits_decode(data: bytes, most: int = 1 << 62) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


#: Codes after a clear code, up to the next one, and the bits of each: they are widened one code early, as the format asks.
LZW_RUN = 3837
_WIDTHS = np.searchsorted(1 << np.arange(13), 259 + np.arange(LZW_RUN + 1)).clip(9, 12)
_WIDTHS[0] = 9
_BIT = np.arange(11, -1, -1)


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first. A longer string is known by its beginning's code and its last byte."""
    runs, codes, table, held = [], [], {}, -1
    for value in raw:
        if held < 0:
            held = value
            continue
        longer = held << 8 | value
        code = table.get(longer)
        if code is not None:
            held = code
            continue
        codes.append(held)
        table[longer] = 257 + len(codes)
        held = value
        if len(codes) == LZW_RUN:
            codes.append(LZW_CLEAR)
            runs.append(codes)
            codes, table = [], {}
    if held >= 0:
        codes.append(held)
    if len(codes) == LZW_RUN + 1:  # no room for the end in this run
        runs.append([*codes[:-1], LZW_CLEAR])
        codes = codes[-1:]
    runs.append([*codes, LZW_END])
    code = np.array([LZW_CLEAR] + [c for r in runs for c in r])
    width = np.concatenate([_WIDTHS[:1], *(_WIDTHS[: len(r)] for r in runs)])
    bits = (code[:, None] >> _BIT & 1).astype(np.uint8)[_BIT < width[:, None]]
    return np.packbits(bits).tobytes()


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    out, size, at = [], 0, 0
    words = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    while size < most:
        # all codes of this run at once: where each begins, and the 12 bits from there
        begin = at + np.concatenate(([0], np.cumsum(_WIDTHS[:-1])))
        begin = begin[begin + _WIDTHS <= 8 * len(data)]
        three = words[begin >> 3] << 16 | words[(begin >> 3) + 1] << 8 | words[(begin >> 3) + 2]
        width = _WIDTHS[: len(begin)]
        codes = (three >> (24 - (begin & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == LZW_CLEAR) | (codes == LZW_END))
        n = int(stop[0]) if len(stop) else len(codes)
        table, last = list(fresh), b""
        add, keep = table.append, out.append
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
                if last:
                    add(last + entry[:1])
            elif code == len(table) and last:
                entry = last + last[:1]
                add(entry)
            else:
                raise ValueError("LZW code before its entry")
            keep(entry)
            size += len(entry)
            last = entry
        if not len(stop) or codes[n] == LZW_END:
            break
        at = int(begin[n] + width[n])
    return b"".join(out)


def compress(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda x: zlib.compress(x, 1), DEFLATE_OLD: lambda x: zlib.compress(x, 1)}[how](raw)


def expand(data: bytes, how: int, most: int) -> bytes:
    """What data holds, up to `most` bytes (about; a block that holds more is as good as a damaged one)."""
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, max(1, most))
    return {NONE: lambda x, _: bytes(x), LZW: lzw_decode, PACKBITS: packbits_decode}[how](data, most)


def differ(block: np.ndarray) -> np.ndarray:
    """Horizontal predictor: each sample less its left neighbour; block is rows x columns x samples."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 16, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of pages (rows x columns or rows x columns x samples, uint8 or uint16), in strips, or in tiles of `tile` (rows, columns)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, samples = page.shape
        kind = np.dtype(page.dtype).newbyteorder(order)
        blocks = []
        if tile:
            th, tw = tile
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, samples), page.dtype)
            full[:h, :w] = page
            blocks = [full[r : r + th, c : c + tw] for r in range(0, full.shape[0], th) for c in range(0, full.shape[1], tw)]
        else:
            blocks = [page[r : r + rows_per_strip] for r in range(0, h, rows_per_strip)]
        where, sizes = [], []
        for b in blocks:
            data = compress((differ(b) if predictor == 2 else b).astype(kind).tobytes(), compression)
            where.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * page.dtype.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, where), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, where), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, field, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{FIELD[field]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(f"{order}I", at)
            entries.append(struct.pack(f"{order}HHI", tag, field, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def read(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Each page's tags and its samples (rows x columns x samples). Raises ValueError where data is no TIFF that is known
    here, or a damaged one; nothing is allocated that the file's own blocks do not fill."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    try:
        at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(f"{order}H", data, at)
            tags: dict = {}
            for k in range(n):
                tag, field, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
                if field in FIELD:
                    size, place = struct.calcsize(f"{order}{FIELD[field]}") * count, at + 10 + 12 * k
                    if size > len(data):
                        raise ValueError("damaged TIFF: a field is longer than the file")
                    if size > 4:
                        (place,) = struct.unpack_from(f"{order}I", data, place)
                    tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[field]}", data, place)
            yield tags, _page(data, tags, order)
            (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except (struct.error, zlib.error, KeyError, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"damaged TIFF: {e!r}") from e


def _page(data: bytes, tags: dict, order: str) -> np.ndarray:
    h, w = tags[HEIGHT][0], tags[WIDTH][0]
    samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (8,))[0]
    if bits not in (8, 16) or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("bit depth or plane layout is not known here")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    bh, bw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, (h,))[0], h), w)
    if min(h, w, samples, bh, bw) < 1:
        raise ValueError("damaged TIFF: a size is 0")
    across, down = -(-w // bw), -(-h // bh)
    places = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    if len(places) != across * down:
        raise ValueError(f"damaged TIFF: {len(places)} blocks for {across} x {down}")
    blocks = []
    for k, (at, size) in enumerate(places):
        rows = bh if tiled else min(bh, h - k * bh)
        want = rows * bw * samples * kind.itemsize
        raw = expand(data[at : at + size], tags.get(COMPRESSION, (1,))[0], want)
        if len(raw) < want:
            raise ValueError("damaged TIFF: a block ends early")
        block = np.frombuffer(raw, kind, rows * bw * samples).reshape(rows, bw, samples).astype(kind.newbyteorder("="))
        if tags.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        blocks.append(block)
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    for k, block in enumerate(blocks):
        r, c = k // across * bh, k % across * bw
        out[r : r + bh, c : c + bw] = block[: h - r, : w - c]
    return out


#: Bytes of pixels that a task hands on at once.
LOT_BYTES = 16_000_000


def pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per page: id, page, width, height, bits, samples, compression, predictor, tiled, pixels (bytes), error.

    A null, empty or damaged file gives one row with page null and the reason in error, after the pages before the damage.
    Repeated rows repeat; an empty table gives no rows; further columns are ignored, whatever their names. A task holds one
    file and about LOT_BYTES of pixels.
    """
    names = ["id", "page", "width", "height", "bits", "samples", "compression", "predictor", "tiled", "pixels", "error"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    schema = "id string, page int, width long, height long, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"

    def rows_of(key, data):
        try:
            for k, (tags, img) in enumerate(read(data)):
                form = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], TILE_OFFSETS in tags
                yield key, k, img.shape[1], img.shape[0], 8 * img.dtype.itemsize, img.shape[2], *form, img.tobytes(), None
        except ValueError as e:
            yield key, *[None] * 9, str(e)

    def run(batches):
        out, held = [], 0

        def lot():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    out.append(row)
                    held += len(row[9] or b"")
                    if held > LOT_BYTES:
                        yield lot()
                        out, held = [], 0
        if out:
            yield lot()

    return media.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


#: Columns of a text's page, rows of a page, and a tile's rows and columns.
COLUMNS, PAGE_ROWS, TILE = 576, 512, (16, 96)


def form_of(raw: bytes) -> tuple[int, int, tuple[int, int] | None]:
    """Compression, predictor and tile of a text's TIFF: each is chosen by a hash of its bytes, so that texts of any size
    go through all of them, and equal texts through the same."""
    h = zlib.crc32(raw)
    return (LZW, PACKBITS, DEFLATE)[h % 3], 1 + h // 3 % 2, TILE if h // 6 % 4 == 0 else None


def from_text(raw: bytes) -> bytes:
    """A text's bytes, filled with 255 to a positive multiple of 576, as a TIFF of 8-bit samples."""
    full = raw + b"\xff" * (COLUMNS * max(1, -(-len(raw) // COLUMNS)) - len(raw))
    rows = np.frombuffer(full, np.uint8).reshape(-1, COLUMNS)
    compression, predictor, tile = form_of(raw)
    return write([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], compression, predictor, tile=tile)


def described(samples: np.ndarray, page_count: int) -> str:
    """Pages, mean, deviation, and the shares of eight equal ranges of samples in thousandths."""
    count = np.bincount(samples, minlength=256)
    n, value = samples.size, np.arange(256)
    mean = float(count @ value) / n
    deviation = max(0.0, float(count @ value**2) / n - mean**2) ** 0.5
    return f"{page_count};{mean:.3f};{deviation:.3f};" + "-".join(str(1000 * int(x) // n) for x in count.reshape(8, 32).sum(axis=1))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a TIFF and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. Null is empty and gives one row of 255. Equal texts give equal values; repeated rows repeat; an
    empty table gives no rows; further columns are ignored, whatever their names; texts of any length are stored whole."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for piece, data, off in slices(batches):
            raw, out = data.tobytes(), []
            for a, b in zip(off.tolist(), off[1:].tolist(), strict=False):
                media = from_text(raw[a:b])
                images = [img for _, img in read(media)]
                payload = b"".join(x.tobytes() for x in images)
                out.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), described(np.frombuffer(payload, np.uint8), len(images))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_tiff_media(spark, sf_dir):
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
