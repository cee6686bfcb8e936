import hashlib
import io
import zlib

import numpy as np
import pytest

from doctally.llm import media as M


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (24, 24)])
def test_round_trips(shape):
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, shape, np.uint8), rng.integers(0, 256, (*shape, 3), np.uint8)
    assert (M.decode(M.encode_pgm(grey)) == grey).all() and (M.decode(M.encode_bmp(colour)) == colour).all()
    plain = f"P2\n# note\n{shape[1]} {shape[0]}\n255\n" + " ".join(map(str, grey.ravel()))
    assert (M.decode(plain.encode()) == grey).all()
    assert (M.decode(b"P6 %d %d 255\n" % shape[::-1] + colour.tobytes()) == colour).all()
    assert (M.decode(b"P5 %d %d 65535\n" % shape[::-1] + (grey.astype(">u2") * 257).tobytes()) == grey).all()


def test_bitmaps_and_junk():
    assert M.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]] and M.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert all(M.decode(x) is None for x in (None, b"", b"P5", b"P5 9 9 255\nx", b"BM123", b"GIF89a"))


def test_headers_that_lie_decode_to_none(spark):
    bad = [b"P5 " + b"9" * 30 + b" 1 255\n\x00", b"P2 1 1 255\n" + b"1" * 40, b"P5 1 1 0\n\x00", b"P2 1 1 10\n11", b"P5 99999999 99999999 255\n\x00", b"P2 1 1 255 x", b"P6 1 1 70000\n" + b"\0" * 6, M.struct.pack("<2sIHHIIiiHHI", b"BM", 54, 0, 0, 54, 40, 0, 0, 1, 24, 0)]
    assert [M.decode(x) for x in bad] == [None] * len(bad)
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)], "i long, m binary")
    assert all(r["tile"] is None and r["dhash"] is None for r in M.media_features(frame, "i", "m").collect())


def brute_resize(a, height, width):
    """Means over areas, sample by sample, each by the share of it that lies within the cell."""
    h, w = a.shape
    share = lambda k, n, cells: np.array([max(0.0, min(i + 1, (k + 1) * n / cells) - max(i, k * n / cells)) for i in range(n)])
    return np.array([[share(y, h, height) @ a @ share(x, w, width) / (h * w / height / width) for x in range(width)] for y in range(height)])


@pytest.mark.parametrize("shape", [(24, 24), (24, 9), (5, 24), (48, 24), (7, 3), (1, 1)])
def test_features_by_brute_force(shape):
    a = np.random.default_rng(3).integers(0, 256, shape, np.uint8)
    cells = brute_resize(a.astype(float), 8, 9)
    assert np.allclose(M.area_resize(a, 8, 9), cells)
    bits = "".join("01"[int(round(cells[y, x + 1], 6) > round(cells[y, x], 6))] for y in range(8) for x in range(8))
    assert M.difference_hash(a) == f"{int(bits, 2):016x}"
    assert (np.load(io.BytesIO(M.npy_tile(a))) == np.clip(np.rint(brute_resize(a.astype(float), 24, 24)), 0, 255)).all()
    colour = np.random.default_rng(4).integers(0, 256, (*shape, 3), np.uint8)
    assert np.allclose(M.area_resize(colour, 8, 9), brute_resize(colour.sum(2) / 3, 8, 9))


def test_area_resize_is_the_mean_of_areas():
    a = np.random.default_rng(1).integers(0, 256, (12, 18))
    assert np.allclose(M.area_resize(a, 3, 6), a.reshape(3, 4, 6, 3).mean((1, 3)))
    fine = np.kron(a, np.ones((5, 7)))
    assert np.allclose(M.area_resize(a, 5, 7), fine.reshape(5, 12, 7, 18).mean((1, 3)))
    assert M.npy_tile(a)[:6] == b"\x93NUMPY" and np.load(io.BytesIO(M.npy_tile(a))).shape == (24, 24)


def test_payloads(spark, docs, stored, clash):
    texts = [(1, "héllo", "en"), (2, None, "en"), (3, "", "en"), (4, "x" * 576, "en"), (5, "y" * 300_001, "en"), (6, "héllo", "en"), (6, "héllo", "en"), (None, "z", "en")]
    found = M.op4_media_columns(spark, stored(documents=clash(docs(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = (dict((i, t) for i, t, _ in texts)[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        grey = np.frombuffer(want, np.uint8).reshape(-1, 24)
        assert r["media_bytes"] > len(want) and r["feature"] == M.difference_hash(grey) and bytes(r["tile"]) == M.npy_tile(grey)
        assert r["bmp_feature"] == M.difference_hash(grey.reshape(-1, 8, 3)) and r["bmp_sha256"] == hashlib.sha256(M.encode_bmp(grey.reshape(-1, 8, 3))).hexdigest()
    assert len({(r["media_sha256"], r["feature"]) for r in found if r["doc_id"] in (1, 6)}) == 1
    images = spark.createDataFrame([(1, bytearray(M.encode_pgm(np.eye(9, dtype=np.uint8)))), (2, None), (3, bytearray(b"no"))], "i long, m binary")
    assert [(r["i"], r["height"], r["tile"] is None) for r in M.media_features(images, "i", "m").collect()] == [(1, 9, False), (2, None, True), (3, None, True)]
    assert M.payload_media(docs([])).count() == 0
