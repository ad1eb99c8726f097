"""The WebP codec's round trips and the media query."""

import hashlib
import zlib

import numpy as np
import pytest

from quern.llm import media, webp
from tests.llm.edge import PROSE, empty, odd

RNG = np.random.default_rng(5)


def images():
    for h, w in ((1, 1), (5, 7), (17, 33)):
        yield RNG.integers(0, 1 << 32, (h, w), dtype=np.uint32)
        yield RNG.integers(0, 4, (h, w), dtype=np.uint32) * 0x10101 | 0xFF000000


@pytest.mark.parametrize("options", [{}, {"subtract": True}, {"cache_bits": 1}, {"cache_bits": 10}, {"subtract": True, "cache_bits": 4}])
def test_plain_transforms_and_cache(options):
    for im in images():
        assert (webp.decode(webp.encode(im, **options)) == im).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors_and_cross_colour(mode):
    for im in images():
        tiles = (-(-im.shape[0] // 4), -(-im.shape[1] // 4))
        colour = RNG.integers(0, 1 << 24, tiles, dtype=np.uint32) | np.uint32(0xFF000000)
        assert (webp.decode(webp.encode(im, predictor=np.full(tiles, mode), colour=colour, subtract=True, cache_bits=2)) == im).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    p = RNG.integers(0, 1 << 32, colours, dtype=np.uint32)
    im = p[RNG.integers(0, colours, (9, 31))]
    assert (webp.decode(webp.encode(im, palette=True)) == im).all()


def test_references():
    im = np.tile(np.arange(20, dtype=np.uint32) * 77 | 0xFF000000, (10, 3))
    for options in ({"matches": {20: (580, 20)}}, {"matches": {60: (540, 60)}, "cache_bits": 5}, {"matches": {40: (20, 1 * 20), 80: (100, 80)}}):
        flat = im.ravel().copy()
        for at, (n, back) in options["matches"].items():
            for i in range(at, at + n):
                flat[i] = flat[i - back]
        assert (webp.decode(webp.encode(flat.reshape(im.shape), **options)) == flat.reshape(im.shape)).all()
    assert len(set(webp.NEAR)) == 120


def test_damage_is_told():
    data = webp.encode(next(images()))
    for bad in (b"", data[:30], data[:20] + b"\0" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


@pytest.mark.parametrize("data", [b"", b"a", b"abc\n" * 3000, bytes(range(256)) * 300, b"\xff" * 2000, "漢字".encode() * 30_000, b"same line here\n" * 5000, b"q" * 9_500_000])
def test_payloads_come_back(data):
    p = media.payload_of(data)
    assert len(p) % 576 == 0 and p.startswith(data) and media.load(media.store(p)).tobytes() == p


@pytest.mark.parametrize(
    "plan,data",
    [("grey", (PROSE * 5)[:576].encode()), ("palette", "Φίλος και ζωή ".encode() * 90 + bytes(range(60))), ("packed", b"0123456789,.\n" * 200), ("packed", b"ab" * 900), ("packed", b""), ("step", bytes(i * 3 // 2 & 255 for i in range(4032)))],
)
def test_plans_are_chosen_by_size_and_come_back(plan, data):
    p = media.payload_of(data)
    samples = np.frombuffer(p, dtype=np.uint8)
    assert webp.best_plan(samples, 576)[0] == plan
    assert media.load(media.store(p)).tobytes() == p


def bits_of(*parts):
    """Bytes of (value, number of bits), least significant first."""
    value = n = 0
    for v, k in parts:
        value, n = value | v << n, n + k
    return value.to_bytes(-(-n // 8), "little")


def test_files_that_are_written_out_by_hand():
    """Streams put together bit by bit after the format's text, without this encoder."""
    only = lambda s: ((1, 1), (0, 1), (1, 1), (s, 8))  # noqa: E731  a simple code of one 8-bit symbol
    two = lambda a, b: ((1, 1), (1, 1), (1, 1), (a, 8), (b, 8))
    start = lambda w, h: ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3))
    # one red-green-blue-alpha pixel, no transform, no cache, one group
    plain = bits_of(*start(1, 1), (0, 1), (0, 1), (0, 1), *only(20), *only(10), *only(30), *only(255), *only(0))
    assert webp.decode(webp.riff(plain)).tolist() == [[0xFF0A141E]]
    # three pixels of two greens: one bit each; green is added to red and blue again
    greens = bits_of(*start(3, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *two(5, 9), *only(1), *only(2), *only(255), *only(0), (0, 1), (1, 1), (0, 1))
    assert webp.decode(webp.riff(greens)).tolist() == [[0xFF060507, 0xFF0A090B, 0xFF060507]]
    # a palette of two colours, eight pixels in one byte of green: 0b10110001
    table = ((0, 1), *two(0, 7), *only(0), *only(0), *two(0, 255), *only(0), (0, 1), (1, 1), (1, 1), (0, 1))
    packed = bits_of(*start(8, 1), (1, 1), (3, 2), (1, 8), *table, (0, 1), (0, 1), (0, 1), *only(0b10110001), *only(0), *only(0), *only(255), *only(0))
    assert webp.decode(webp.riff(packed)).tolist() == [[0xFF000700 if 0b10110001 >> i & 1 else 0xFF000000 for i in range(8)]]
    # the predictor of left neighbours over a row of equal steps
    steps = bits_of(*start(4, 1), (1, 1), (0, 2), (0, 3), (0, 1), *only(1), *only(0), *only(0), *only(255), *only(0), (0, 1), (0, 1), (0, 1), *only(3), *only(0), *only(0), *only(0), *only(0))
    assert webp.decode(webp.riff(steps)).tolist() == [[0xFF000300, 0xFF000600, 0xFF000900, 0xFF000C00]]


def test_query(spark):
    from quern.llm.registry import queries

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries()["op7_media"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = media.payload_of(texts[r.doc_id])
        m = media.store(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest())


def test_odd_rows(spark):
    rows = [r for r in media.media_digests(odd(spark)).collect()]
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 19 and by[3].payload_bytes == 576 == by[4].payload_bytes and by[3].feature == by[4].feature and by[1].media_sha256 == by[2].media_sha256
    assert media.media_digests(empty(spark)).count() == 0
    read = media.read_media(media.media_table(odd(spark))).where("doc_id = 1").first()
    assert bytes(read.pixels) == media.payload_of(odd(spark).where("doc_id = 1").first().text.encode())
