import struct
import zlib

import numpy as np
import pytest

from lumenqc.sources import decoding as d


def png(path, rgb):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w = rgb.shape[:2]
    lines = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in rgb)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def marked(order, value, entries=1):
    sign = {"<": b"II", ">": b"MM"}[order]
    other = struct.pack(f"{order}HHIHH", 0x0100, 3, 1, 7, 0) * (entries - 1)
    block = sign + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", entries) + other + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, value, 0)
    body = b"Exif\0\0" + block
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


@pytest.mark.parametrize("order", "<>")
def test_orientation_is_read(order):
    other = b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF"
    for value in range(1, 9):
        assert d.orientation(b"\xff\xd8" + other + marked(order, value, 3)) == value
    assert d.orientation(b"\xff\xd8" + marked(order, 99)) == 1
    for broken in (b"", b"\xff\xd8", b"\xff\xd8\xff", b"no", b"\xff\xd8" + marked(order, 6)[:-9], b"\xff\xd8\xff\xe1\xff\xffExif\0\0II"):
        assert d.orientation(broken) == 1


def test_upright_puts_every_pixel_in_its_place():
    image = np.arange(2 * 3).reshape(2, 3, 1)
    h, w = 2, 3
    to = {1: lambda y, x: (y, x), 2: lambda y, x: (y, w - 1 - x), 3: lambda y, x: (h - 1 - y, w - 1 - x), 4: lambda y, x: (h - 1 - y, x), 5: lambda y, x: (x, y),
          6: lambda y, x: (x, h - 1 - y), 7: lambda y, x: (w - 1 - x, h - 1 - y), 8: lambda y, x: (w - 1 - x, y)}
    for how, place in to.items():
        got = d.upright(image, how)
        assert got.shape[:2] == ((h, w) if how < 5 else (w, h))
        for y in range(h):
            for x in range(w):
                assert got[place(y, x)] == image[y, x], how


def test_memory_steps_down(monkeypatch):
    tried = []

    def scarce(image, most):
        tried.append(most)
        if most > 10:
            raise MemoryError
        return image

    monkeypatch.setattr(d, "shrunk", scarce)
    assert d.prepared(bytes(12), 2, 2, 3, 1, (40, 20, 10)).shape == (2, 2, 3)
    assert tried == [40, 20, 10]
    with pytest.raises(MemoryError):
        d.prepared(bytes(12), 2, 2, 3, 1, (40, 20))


def test_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    small, large = rng.integers(0, 256, (3, 5, 3)), rng.integers(0, 256, (40, 20, 3))
    png(tmp_path / "small.png", small)
    png(tmp_path / "large.png", large)
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8 not a picture")
    (tmp_path / "empty.png").write_bytes(b"x")  # of no bytes at all Spark lists none
    (tmp_path / "notes.txt").write_text("x")
    image = spark._jvm.java.awt.image.BufferedImage(4, 2, 1)
    for y in range(2):
        for x in range(4):
            image.setRGB(x, y, 0xFF0000 if x < 2 else 0x0000FF)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "turned.jpg")))
    raw = (tmp_path / "turned.jpg").read_bytes()
    (tmp_path / "turned.jpg").write_bytes(raw[:2] + marked(">", 6) + raw[2:])
    got = {r.path.rsplit("/", 1)[-1]: r for r in d.decoded(spark, str(tmp_path), (16,)).collect()}
    assert set(got) == {"small.png", "large.png", "broken.jpg", "empty.png", "turned.jpg"}
    assert got["broken.jpg"].error and got["empty.png"].error and got["broken.jpg"].r is None
    s = got["small.png"]
    assert (s.height, s.width, s.error) == (3, 5, None)
    assert [s.r, s.g, s.b] == [small[..., k].ravel().tolist() for k in range(3)]
    big = got["large.png"]
    assert (big.height, big.width) == (16, 8)
    assert np.allclose([np.mean(big[c]) for c in "rgb"], large.mean((0, 1)), atol=12)
    t = got["turned.jpg"]
    assert (t.height, t.width, t.orientation) == (4, 2, 6)  # red, left in the file, is above
    assert min(t.r[:4]) > 150 and max(t.r[4:]) < 100 and min(t.b[4:]) > 150


def test_no_pictures(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    assert d.decoded(spark, str(tmp_path)).count() == 0
