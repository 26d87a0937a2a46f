import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from fluence.llm import tiff


def random_page(rng, h, w, s, kind):
    page = rng.integers(0, np.iinfo(kind).max, (h, w, s), dtype=kind)
    page[:, : w // 2] = page[:1, :1]
    return page


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (16, 32)])
def test_round_trip(compression, order, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [random_page(rng, h, w, s, k) for h, w, s, k in ((5, 7, 1, np.uint8), (40, 33, 3, np.uint8), (17, 20, 1, np.uint16))]
    data = tiff.write(pages, compression, predictor, rows_per_strip=4, tile=tile, order=order)
    got = list(tiff.read(data))
    assert len(got) == 3 and all(np.array_equal(a, b) for a, (_, b) in zip(pages, got, strict=True))


def test_codecs():
    rng = random.Random(2)
    for n in (0, 1, 2, 127, 128, 129, 300, 9000):
        for top in (1, 3, 255):
            raw = bytes(rng.randint(0, top) for _ in range(n))
            assert tiff.packbits_decode(tiff.packbits_encode(raw)) == raw
            assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def changed(data, tag, value):
    """data with another value for a tag of its (only) directory."""
    out, (at,) = bytearray(data), struct.unpack_from("<I", data, 4)
    for k in range(struct.unpack_from("<H", data, at)[0]):
        place = at + 2 + 12 * k
        if struct.unpack_from("<H", data, place)[0] == tag:
            struct.pack_into("<I", out, place + 8, value)
    return bytes(out)


def test_damaged_files_give_an_error_row(spark):
    good = tiff.write([np.zeros((3, 4), np.uint8)])
    bad = {"b": None, "c": b"", "d": good[:20], "e": b"II*\0" + b"\xff" * 30}
    for tag in (tiff.WIDTH, tiff.HEIGHT, tiff.SAMPLES, tiff.ROWS_PER_STRIP, tiff.BITS, tiff.COMPRESSION, tiff.STRIP_OFFSETS, tiff.STRIP_BYTES):
        bad |= {f"{tag}:{v}": changed(good, tag, v) for v in (0, 4_000_000_000)}
    tiled = tiff.write([np.zeros((3, 4), np.uint8)], tile=(16, 16))
    bad |= {f"tile:{t}:{v}": changed(tiled, t, v) for t in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT) for v in (0, 4_000_000_000)}
    rows = [("a", bytearray(good))] + [(k, None if v is None else bytearray(v)) for k, v in bad.items()]
    got = {r.id: r for r in tiff.pages(spark.createDataFrame(rows, "id string, media binary"), "id", "media").collect()}
    assert got["a"].error is None and got["a"].width == 4 and bytes(got["a"].pixels) == bytes(12)
    fine = {f"{t}:4000000000" for t in (tiff.ROWS_PER_STRIP, tiff.STRIP_BYTES)}  # the strip is all there
    wrong = [k for k in bad if (got[k].error is None) != (k in fine) or (got[k].page is None) != (k not in fine)]
    assert not wrong


def test_any_damage_is_an_error_or_a_page():
    rng = random.Random(4)
    for compression in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE, tiff.NONE):
        good = tiff.write([np.arange(2000, dtype=np.uint8).reshape(40, 50)] * 2, compression, 2, tile=rng.choice([None, (16, 16)]))
        for _ in range(400):
            data = bytearray(good)
            for _ in range(rng.randrange(1, 6)):
                data[rng.randrange(4, len(data))] = rng.randrange(256)
            try:
                list(tiff.read(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])])))
            except ValueError:
                pass


def test_pages_of_repeated_rows_clashing_columns_and_an_empty_table(spark):
    good = bytearray(tiff.write([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint16)]))
    df = spark.createDataFrame([("a", good, 9, "x"), ("a", good, 9, "x")], "id string, media binary, page int, error string")
    got = tiff.pages(df, "id", "media").collect()
    assert sorted((r.page, r.bits, r.error) for r in got) == [(0, 8, None), (0, 8, None), (1, 16, None), (1, 16, None)]
    assert tiff.pages(df.limit(0), "id", "media").collect() == []


def test_every_form_is_used_for_texts_of_every_size():
    for size in (3, 2000, 30_000):
        forms = {tiff.form_of(str(i).encode() * size) for i in range(400)}
        assert len(forms) == 12
    for i in range(40):
        raw = f"text {i} ".encode() * (i * i)
        pages = list(tiff.read(tiff.from_text(raw)))
        assert b"".join(p.tobytes() for _, p in pages)[: len(raw)] == raw


def test_text_media(spark):
    texts = ["", None, "a", "x" * 576, "é" * 300, "line\n" * 5000, "y" * 400_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, "a", "y", 2)], "doc_id long, text string, feature string, n_bytes int")
    rows = tiff.text_media(df).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and tiff.text_media(df.limit(0)).collect() == []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[6].feature.startswith("2;")
