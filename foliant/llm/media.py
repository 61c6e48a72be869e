"""Media columns: Netpbm and BMP images as arrays, tiles and difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP (1, 4, 8, 24 and
32 bits) into an array of height x width x channels. ``area_resize`` averages exact areas by the
integral image. ``npy_tiles`` cuts an image into tiles in NPY format, and ``difference_hash`` gives
64 bits that similar images share.

Samples whose largest value is below 255 (or, of 16 bits, below 65,535) are scaled to the full range, as
viewers show them. A row whose image cannot be read gets null features and the reason in ``error``, and
no tiles: numbers out of range, samples above the largest one, pixels or a palette that end early, images
without pixels, and kinds of BMP that are not named above. A null image gives null. Sizes are held
against the bytes that are there before anything is set aside for them. Repeated rows and rows with a
null id give values like any other, a very long text or large image is one array in one task, and an
empty table gives an empty result. Columns other than id and image are ignored. In the query a null text
counts as empty, and the payload of any text is stored as a raw PPM, 64 pixels (192 bytes) a row.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm._shared import require, slices, table

ROW_BYTES = 192
TILE = 64
_HEADER = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels; samples of 8 bits, or 16 where the image has more."""
    kind = bytes(data[:2])
    if kind == b"BM":
        return _decode_bmp(data)
    if len(kind) == 2 and kind[:1] == b"P" and kind[1:] in b"123456":
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _scaled(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to ``top`` as 8 bits, or as 16 where ``top`` is above 255."""
    full = 65535 if top > 255 else 255
    if samples.size and int(samples.max()) > top:
        raise ValueError("sample above the largest one")
    if top != full:
        samples = (samples.astype(np.int64) * full + top // 2) // top
    return samples.astype(np.uint16 if top > 255 else np.uint8)


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("header ends early")
        if len(m[1].lstrip(b"0")) > 10:
            raise ValueError("number out of range")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = (*numbers, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not n:
        raise ValueError("image without pixels")
    if not 0 < top < 65536:
        raise ValueError("largest sample out of range")
    # Known before anything is set aside for them: a sample takes a bit, one byte or two, or a character.
    if len(data) - at < (-(-width // 8) * height if kind == 4 else n * 2 if kind > 4 and top > 255 else n):
        raise ValueError("samples end early")
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), dtype=np.uint8)[:n]
        if bits.size != n or not np.isin(bits, (48, 49)).all():
            raise ValueError("samples that are no bits")
        return ((49 - bits) * np.uint8(255)).reshape(height, width, 1)
    if kind == 4:
        stride = -(-width // 8)
        raw = np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=at + 1).reshape(height, stride)
        return ((1 - np.unpackbits(raw, axis=1)[:, :width]) * np.uint8(255)).reshape(height, width, 1)
    if kind in (2, 3):
        found = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]
        if len(found) != n or not all(x.isdigit() and len(x) <= 10 for x in found):
            raise ValueError("samples that are no numbers")
        samples = np.array([int(x) for x in found], dtype=np.int64)
    else:
        samples = np.frombuffer(data, dtype=">u2" if top > 255 else np.uint8, count=n, offset=at + 1)
    return _scaled(samples, top).reshape(height, width, channels)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("BMP header ends early")
    start, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if header < 40:
        raise ValueError("BMP header of an old kind")
    width, height, _, bits, compression = struct.unpack_from("<iiHHI", data, 18)
    if compression not in (0, 3) or (compression == 3 and bits != 32):
        raise ValueError("compressed BMP")
    if compression == 3 and struct.unpack_from("<III", data.ljust(66, b"\0"), 54) != (0xFF0000, 0xFF00, 0xFF):
        raise ValueError("BMP with channels of its own")
    if bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits")
    if width <= 0 or height == 0:
        raise ValueError("image without pixels")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if start + stride * rows > len(data):
        raise ValueError("samples end early")
    raw = np.frombuffer(data, dtype=np.uint8, count=stride * rows, offset=start).reshape(rows, stride)
    if bits in (24, 32):
        image = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        if 14 + header + colours * 4 > len(data):
            raise ValueError("palette ends early")
        palette = np.frombuffer(data, dtype=np.uint8, count=colours * 4, offset=14 + header).reshape(-1, 4)[:, 2::-1]
        index = raw if bits == 8 else np.unpackbits(raw, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        index = index[:, :width]
        if int(index.max()) >= colours:
            raise ValueError("sample outside of the palette")
        image = palette[index]
    return np.ascontiguousarray(image if height < 0 else image[::-1]).astype(np.uint8)


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over exact areas: differences of the integral image, read between whole pixels."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    total[1:, 1:] = image.astype(np.float64).cumsum(axis=0).cumsum(axis=1)

    def read(table: np.ndarray, n: int, size: int) -> np.ndarray:
        """Sums up to each of n + 1 even places along the first axis."""
        at = np.arange(n + 1) * (size / n)
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    rows = np.diff(read(total, height, h), axis=0)
    cells = np.diff(read(rows.transpose(1, 0, 2), width, w), axis=0).transpose(1, 0, 2)
    return cells / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 grey areas is brighter than its left neighbour."""
    grey = image[:, :, :3].mean(axis=2, keepdims=True)
    small = np.round(area_resize(grey, 8, 9)[:, :, 0], 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of each tile; those at the right and lower edges may be smaller."""
    out = []
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            f = io.BytesIO()
            np.save(f, np.ascontiguousarray(image[y : y + tile, x : x + tile]), allow_pickle=False)
            out.append((y // tile, x // tile, f.getvalue()))
    return out


def media_features(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, height, width, channels, dhash, error): decoded where the rows are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch.column(image_col).to_pylist():
                try:
                    image = None if data is None else decode(data)
                    rows.append((None,) * 5 if image is None else (*image.shape, difference_hash(image), None))
                except ValueError as e:
                    rows.append((None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, "height", "width", "channels", "dhash", "error"])

    kind = images.schema[id_col].dataType.simpleString()
    return require(images, id_col, image_col).mapInArrow(
        run, f"`{id_col}` {kind}, height int, width int, channels int, dhash string, error string"
    )


def media_tiles(images: DataFrame, tile: int = TILE, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, tile_row, tile_col, npy): one row per tile; rows that cannot be read give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for ident, data in zip(batch.column(id_col), batch.column(image_col).to_pylist()):
                try:
                    cut = [] if data is None else npy_tiles(decode(data), tile)
                except ValueError:
                    continue
                if cut:
                    row, col, npy = zip(*cut)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ident.as_py()] * len(cut), batch.schema.field(id_col).type), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(npy, pa.binary())],
                        [id_col, "tile_row", "tile_col", "npy"],
                    )

    kind = images.schema[id_col].dataType.simpleString()
    return require(images, id_col, image_col).mapInArrow(run, f"`{id_col}` {kind}, tile_row int, tile_col int, npy binary")


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes padded with spaces to a positive multiple of a row)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")


def text_as_media(text: str | None) -> tuple:
    """Store a text's payload as a PPM, read the stored bytes back and describe what was read."""
    n, padded = payload(text)
    stored = encode_ppm(np.frombuffer(padded, dtype=np.uint8).reshape(-1, ROW_BYTES // 3, 3))
    image = decode(stored)
    back = image.tobytes()
    tiles = npy_tiles(image)
    return (
        n,
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-16:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        difference_hash(image),
        len(tiles),
        hashlib.sha256(b"".join(t[2] for t in tiles)).hexdigest(),
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    for batch in slices(batches):
        rows = [text_as_media(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], OUT)


OUT = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256"]


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text")
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles_sha256 string"
    return docs.mapInArrow(_texts, kinds)
