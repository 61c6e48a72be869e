import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from foliant.llm import media as M

RNG = np.random.default_rng(0)
RGB = RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8)
GREY = RNG.integers(0, 256, (5, 7, 1)).astype(np.uint8)


def text_form(kind, image, top=255):
    return f"P{kind}\n# a comment\n{image.shape[1]} {image.shape[0]}\n{top}\n".encode() + " ".join(map(str, image.ravel())).encode()


def test_netpbm():
    assert (M.decode(M.encode_ppm(RGB)) == RGB).all()
    assert (M.decode(text_form(3, RGB)) == RGB).all()
    assert (M.decode(text_form(2, GREY)) == GREY).all()
    assert (M.decode(b"P5 # c\n7 5 255\n" + GREY.tobytes()) == GREY).all()
    deep = RNG.integers(0, 65536, (3, 4, 1)).astype(">u2")
    assert (M.decode(b"P5 4 3 65535\n" + deep.tobytes()) == deep).all()
    bits = RNG.integers(0, 2, (3, 11)).astype(np.uint8)
    want = ((1 - bits) * 255)[:, :, None]
    assert (M.decode(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes()) == want).all()
    assert (M.decode(b"P1 11 3\n" + "".join(map(str, bits.ravel())).encode()) == want).all()


def bmp(pixels, bits, palette=b"", flip=True, width=None, compression=0):
    height, stride = pixels.shape[0], -(-pixels.shape[1] // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : pixels.shape[1]] = pixels[::-1] if flip else pixels
    head = struct.pack("<IiiHHIIiiII", 40, width, height if flip else -height, 1, bits, compression, rows.size, 0, 0, len(palette) // 4, 0)
    start = 14 + len(head) + len(palette)
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + head + palette + rows.tobytes()


def test_bmp():
    flat = RGB[:, :, ::-1].reshape(5, -1)
    assert (M.decode(bmp(flat, 24, width=7)) == RGB).all()
    assert (M.decode(bmp(flat, 24, width=7, flip=False)) == RGB).all()
    four = np.concatenate([RGB[:, :, ::-1], np.zeros((5, 7, 1), np.uint8)], axis=2).reshape(5, -1)
    assert (M.decode(bmp(four, 32, width=7)) == RGB).all()
    colours = RNG.integers(0, 256, (16, 3)).astype(np.uint8)
    palette = np.concatenate([colours[:, ::-1], np.zeros((16, 1), np.uint8)], axis=1).tobytes()
    index = RNG.integers(0, 16, (5, 7))
    assert (M.decode(bmp(index.astype(np.uint8), 8, palette, width=7)) == colours[index]).all()
    nibbles = np.pad(index, ((0, 0), (0, 1)))
    packed = (nibbles[:, ::2] << 4 | nibbles[:, 1::2]).astype(np.uint8)
    assert (M.decode(bmp(packed, 4, palette, width=7)) == colours[index]).all()


def test_area_resize_means():
    image = RNG.integers(0, 256, (12, 18, 2)).astype(float)
    assert np.allclose(M.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(M.area_resize(image, 12, 18), image)
    fine = np.repeat(np.repeat(image, 5, axis=0), 7, axis=1)  # area means do not hang on how finely it is cut
    assert np.allclose(M.area_resize(image, 5, 7), fine.reshape(5, 12, 7, 18, 2).mean(axis=(1, 3)))
    assert np.allclose(M.area_resize(np.full((1, 1, 1), 9.0), 8, 9), 9)


def test_tiles_put_together():
    image = RNG.integers(0, 256, (70, 130, 3)).astype(np.uint8)
    back = np.zeros_like(image)
    for r, c, data in M.npy_tiles(image):
        part = np.load(io.BytesIO(data), allow_pickle=False)
        back[r * 64 : r * 64 + part.shape[0], c * 64 : c * 64 + part.shape[1]] = part
    assert (back == image).all()


@pytest.mark.parametrize("text", [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "z" * 300_000])
def test_payload_round_trip(text):
    n, size, sha, tail, stored, _, feature, tiles, _ = M.text_as_media(text)
    raw = (text or "").encode()
    want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    assert (n, size, sha, tail) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert size % 192 == 0 and size > 0 and stored > size and len(feature) == 16 and tiles >= 1


def test_broken_and_null_images(spark):
    good = M.encode_ppm(RGB)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"P6 9 9 255\n"), (5, b"BM"), (6, b"GIF89a"), (None, good), (7, bmp(RGB[:, :, ::-1].reshape(5, -1), 24, width=7, compression=1))]
    df = spark.createDataFrame([(i, d, "x") for i, d in rows], "id long, image binary, error string")
    got = M.media_features(df).collect()
    assert sorted(str(r.id) for r in got if r.dhash) == ["1", "1", "None"]
    assert {r.id for r in got if r.error} == {3, 4, 5, 6, 7}
    assert M.media_tiles(df).count() == 3
    assert M.media_features(df.limit(0)).count() == M.media_tiles(df.limit(0)).count() == 0


@pytest.mark.parametrize("data", [
    b"P6 99999999999999999999 1 255\n", b"P2 2 1 65535\n70000 1", b"P2 2 1 255\n-1 3", b"P2 2 1 255\n1 300", b"P2 2 1 255\n1 99999999999999999999",
    b"P2 2 1 255\n1_0 3", b"P2 2 1 255\n" + b"9" * 5000 + b" 1", b"P6 0 0 255\n", b"P5 0 4 255\n", b"P1 2 1\n12", b"P1 4 1\n01", b"P5 2 1 9\n\x0a\x01",
    b"P6 4000000000 4000000000 255\n", b"P4 9 9\n", b"P6", b"P", b"", b"P7 1 1 1", b"P5 3 1 65535\n\0\0\0\0\0", b"BM" + b"\xff" * 80, b"BM" + b"\0" * 80,
])
def test_malformed_images_say_why(data):
    with pytest.raises(ValueError):
        M.decode(data)


def test_any_damage_is_a_value_error():
    rng = np.random.default_rng(5)
    flat = RGB[:, :, ::-1].reshape(5, -1)
    whole = [M.encode_ppm(RGB), text_form(2, GREY), text_form(3, RGB), bmp(flat, 24, width=7), bmp(flat[:, :7], 8, bytes(1024), width=7), bmp(flat[:, :4], 4, bytes(64), width=7)]
    for data in whole:
        for _ in range(400):
            broken = bytearray(data)
            for at in rng.integers(0, min(len(data), 60), rng.integers(1, 4)):
                broken[at] = rng.integers(0, 256)
            try:
                image = M.decode(bytes(broken[: rng.integers(1, len(broken) + 1)]))
            except ValueError:
                continue
            assert image.ndim == 3 and image.size and len(M.difference_hash(image)) == 16 and M.npy_tiles(image)


def test_samples_are_scaled_to_the_full_range():
    assert M.decode(b"P2 3 1 4\n0 2 4").ravel().tolist() == [0, 128, 255]
    assert M.decode(b"P5 3 1 15\n" + bytes([0, 7, 15])).ravel().tolist() == [0, 119, 255]
    assert M.decode(b"P2 2 1 1023\n0 1023").ravel().tolist() == [0, 65535]


def plain_hash(image):
    """The difference hash from exact area means, one area at a time."""
    from fractions import Fraction as Q

    grey = image[:, :, :3].astype(object).sum(axis=2)
    h, w = grey.shape

    def mean(y, x):
        total = Q(0)
        for i in range(h):
            tall = min(Q(h * (y + 1), 8), i + 1) - max(Q(h * y, 8), i)
            if tall > 0:
                for j in range(w):
                    wide = min(Q(w * (x + 1), 9), j + 1) - max(Q(w * x, 9), j)
                    if wide > 0:
                        total += tall * wide * int(grey[i, j])
        return total

    bits = "".join(str(int(mean(y, x + 1) > mean(y, x))) for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


@pytest.mark.parametrize("text", ["", "a", "plain words " * 40, "é ü " * 200])
def test_stored_form_hash_and_tiles_against_a_plain_version(text):
    raw = text.encode()
    data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    height = len(data) // 192
    stored = f"P6\n64 {height}\n255\n".encode() + data
    image = np.frombuffer(data, np.uint8).reshape(height, 64, 3)
    tiles = b""
    for top in range(0, height, 64):
        f = io.BytesIO()
        np.save(f, image[top : top + 64].copy())
        tiles += f.getvalue()
    got = M.text_as_media(text)
    assert got[4:] == (len(stored), hashlib.sha256(stored).hexdigest(), plain_hash(image), -(-height // 64), hashlib.sha256(tiles).hexdigest())


def test_one_broken_image_does_not_end_the_job(spark):
    rows = [(1, M.encode_ppm(RGB)), (2, b"P6 99999999999999999999 1 255"), (3, b"P2 2 1 65535 70000 1"), (4, b"P6 0 0 255\n")]
    df = spark.createDataFrame(rows, "id long, image binary")
    assert {r.id: r.error is None for r in M.media_features(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.id for r in M.media_tiles(df).collect()} == {1}
