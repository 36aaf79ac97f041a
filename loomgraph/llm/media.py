"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded with this byte to a positive multiple of BLOCK and stored in rows of WIDTH.
PADDING, BLOCK, WIDTH = 255, 576, 24
HASH_ROWS, HASH_COLUMNS = 8, 9
TILE = 16

HEADER = re.compile(rb"\s*(?:#[^\n]*\n\s*)*([0-9]+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """An image of 8-bit samples as binary Netpbm: P5 if it has two axes, P6 if it has three colours."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or image.ndim == 3 and image.shape[2] != 3:
        raise ValueError("8-bit samples with two axes, or three colours, are needed")
    return b"P%d\n%d %d\n255\n" % (5 if image.ndim == 2 else 6, image.shape[1], image.shape[0]) + image.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (rows, columns) or (rows, columns, 3); bitmaps as 0 for black and 1."""
    kind, at, numbers = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = HEADER.match(data, at)
        if not m:
            raise ValueError("a Netpbm header is cut off")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = [*numbers, 1][:3]
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    size = int(np.prod(shape))
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array(list(b"".join(body.split())) if kind == b"P1" else body.split(), np.int64)[:size]
        values = 49 - values if kind == b"P1" else values
        out = values.astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        return 1 - np.unpackbits(rows, axis=1)[:, :width]
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", size, at + 1)
    if len(out) < size:
        raise ValueError("a Netpbm body is cut off")
    return out.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (grey if the palette is), 24 or 32 bits, as (rows, columns[, 3])."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    word = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, header, width, height, bits = word(10), word(14), word(18, 4, True), word(22, 4, True), word(28, 2)
    if word(30) not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = word(46) or 256
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
        image = palette[rows[:, :width]]
        return image[..., 0] if (palette == palette[:, :1]).all() else image
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit samples (rows, columns) as a BMP with a grey palette."""
    height, width = image.shape
    stride = -(-width // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = b"BM" + (start + body.size).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little")
    info = [(40, 4), (width, 4), (height, 4), (1, 2), (8, 2), (0, 4), (body.size, 4), (2835, 4), (2835, 4), (256, 4), (0, 4)]
    return head + b"".join(v.to_bytes(n, "little") for v, n in info) + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean samples over equal boxes, by differences of an integral image read between its points.

    The integral image takes eight bytes a sample, and twice that while it is made: about 16 times the
    image, one image at a time.
    """
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    for axis, parts in ((0, rows), (1, columns)):
        size = image.shape[axis]
        place = np.arange(parts + 1) * size / parts
        low = np.minimum(place.astype(np.int64), size - 1)
        share = (place - low).reshape((-1, *[1] * (total.ndim - 1)) if axis == 0 else (1, -1, *[1] * (total.ndim - 2)))
        total = total.take(low, axis) * (1 - share) + total.take(low + 1, axis) * share
    boxes = np.diff(np.diff(total, axis=0), axis=1)
    return boxes * (rows * columns / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 9 area means is less than its right neighbour."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    means = np.round(area_resize(grey, HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to ``size`` x ``size`` 8-bit samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.rint(area_resize(image, size, size)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            sizes, media = [], []
            for text in part.column(1):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                padded = data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), bytes([PADDING]))
                media.append(encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_payloads(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded, as a grey Netpbm image.

    A null text is empty and gives one block of padding.  Null ids and repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for cell in batch.column(at):
                data = cell.as_py()
                values = [None] * 7
                if data is not None:
                    image = decode(data)
                    payload = np.ascontiguousarray(image).tobytes()
                    values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), npy_tile(image), difference_hash(image)]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
            rest = [batch.column(i) for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], [*[n for n in names if n != names[at]], *FEATURES])

    return run


#: Columns that are computed from stored media.
FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "feature"]


def media_features(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with its media replaced by what is read back from them.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256,
    tile (NPY bytes) and feature (difference hash).  Null media give nulls, media that are no image
    are an error, and columns of ``stored`` named like a new one are replaced.
    """
    rows = stored.drop(*[c for c in FEATURES if c in stored.columns])
    kept = [f for f in rows.schema if f.name != media_col]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    schema += "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string"
    return rows.mapInArrow(_features(rows.columns, rows.columns.index(media_col)), schema)
