"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles in NPY form and difference hashes.

Everything works on bytes in a column; there is no file access. `encode_pgm` / `decode` are an exact round trip for 8-bit samples.

Nulls: a null payload counts as empty; null media, or bytes that are no valid image, decode to None and give null results. Empty tables give
empty results and repeated rows equal values. Long rows are handled one at a time: memory is some 20 bytes a sample of the largest image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a tile of 24 x 24 samples: payloads are padded to a multiple of it.
TILE = 576
WIDTH = 24


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey (height, width) array of 8-bit samples as binary Netpbm."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A (height, width, 3) RGB array as an uncompressed 24-bit BMP."""
    height, width, _ = samples.shape
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = samples[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    planes = 3 if kind in (3, 6) else 1
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = *numbers[:2], (numbers + [1])[2]
    if not 0 < most < 65536 or width * height > 8 * len(data):  # no form has more than eight samples a byte
        raise ValueError("a header that its data can't have")
    shape = (height, width, 3) if planes == 3 else (height, width)
    if kind == 1:  # digits may stand without space between
        digits = bytes(c for c in data[at:] if c in b"01")[: width * height]
        return (1 - (np.frombuffer(digits, np.uint8) - 48)).reshape(shape) * 255
    if kind in (2, 3):
        values = np.array([int(x) for x in data[at:].split()[: width * height * planes]])
    elif kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", width * height * planes, at + 1)
    if len(values) and values.max() > most:
        raise ValueError("a sample above the largest")
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    return values.astype(np.uint8).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    if width <= 0 or not height:
        raise ValueError("an empty BMP")
    stride = -(-bits * width // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)
        return palette[rows[:, :width]][:, :, 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """8-bit samples of a Netpbm (P1 to P6) or BMP image: (height, width) or (height, width, 3); None if it is neither."""
    try:
        if data and data[:2] == b"BM":
            return _bmp(data)
        if data and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
    except (ValueError, IndexError, OverflowError, TypeError, struct.error):
        pass
    return None


def integral(samples: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the corner; a row and a column of zeros lead."""
    height, width = samples.shape
    out = np.zeros((height + 1, width + 1), np.int64)
    np.cumsum(samples, 0, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], 1, out=out[1:, 1:])
    return out


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas; cells that cut through samples take their share, read off the integral image linearly."""
    grey = samples.astype(np.int64).sum(2) if samples.ndim == 3 else samples
    h, w = grey.shape
    if not h or not w:
        return np.zeros((height, width))
    table = integral(grey)

    def places(n: int, cells: int):
        at = np.arange(cells + 1) * n / cells
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (y, fy), (x, fx) = places(h, height), places(w, width)
    rows = table[y] + (table[y + 1] - table[y]) * fy[:, None]
    sums = rows[:, x] + (rows[:, x + 1] - rows[:, x]) * fx
    cells = np.diff(np.diff(sums, axis=0), axis=1) / (h * w / height / width)
    return cells / 3 if samples.ndim == 3 else cells


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 cells is darker than its right neighbour."""
    cells = np.round(area_resize(samples, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int = WIDTH) -> bytes:
    """The image resized to side x side, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_features(images: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per image: height, width, channels, the NPY bytes of its tile and its difference hash; nulls where it can't be decoded."""
    schema = f"{id_col} {images.schema[id_col].dataType.simpleString()}, height int, width int, channels int, tile binary, dhash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["_media"]:
                a = decode(None if data is None else bytes(data))
                rows.append((None,) * 5 if a is None else (a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, npy_tile(a), difference_hash(a)))
            out = pd.DataFrame(rows, columns=["height", "width", "channels", "tile", "dhash"], dtype=object)
            out.insert(0, id_col, batch["_id"].values)
            yield out

    return images.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media")).mapInPandas(run, schema)


def text_payload(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text, padded with bytes 255 to a positive multiple of a tile; how many of them are its own."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(TILE, -(-len(raw) // TILE) * TILE) - len(raw))


def payload_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a grey image of 24 samples a row, reads the stored bytes back and describes payload and media.

    The payload is stored as a BMP of eight pixels a row too, which must give the same bytes; tile is the NPY file of the grey image's tile.
    """
    schema = (
        f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string, bmp_sha256 string, bmp_feature string, tile binary"
    )
    names = [c.split()[0] for c in schema.split(", ") for c in c.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["_id"], batch["_text"], strict=True):
                n, payload = text_payload(text)
                media = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
                image = decode(media)
                back = image.tobytes()
                bitmap = encode_bmp(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH // 3, 3))
                colour = decode(bitmap)
                if colour.tobytes() != back:
                    raise ValueError("the two stored forms differ")
                grey = (hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image))
                rows.append((i, n, len(back), *grey, hashlib.sha256(bitmap).hexdigest(), difference_hash(colour), npy_tile(image)))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)


def op4_media_columns(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return payload_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
