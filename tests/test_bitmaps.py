"""PNG and TIFF against files put together by hand, and snapshots."""

import struct
import zlib

import numpy as np
import pytest

from framelake.sources import bitmaps
from framelake.sources.bitmaps import BitmapError, decode, encode, shrunk

RNG = np.random.default_rng(0)


def filtered(rows, step, kinds):
    """PNG's filters, byte by byte."""
    h, w = rows.shape
    out = bytearray()
    for y in range(h):
        out.append(kinds[y])
        for i in range(w):
            a = int(rows[y, i - step]) if i >= step else 0
            b = int(rows[y - 1, i]) if y else 0
            c = int(rows[y - 1, i - step]) if y and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(rows[y, i]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) & 255)
    return bytes(out)


def png(w, h, depth, colour, rows, step, kinds=None, extra=b"", split=1):
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = zlib.compress(filtered(rows, step, kinds if kinds is not None else [y % 5 for y in range(h)]))
    cut = -(-len(body) // split)
    return bitmaps.PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + b"".join(part(b"IDAT", body[k : k + cut]) for k in range(0, len(body), cut)) + part(b"IEND", b"")


def eight(v):
    return np.floor(v * 255 + 0.5) / 255


@pytest.mark.parametrize("channels, colour", [(1, 0), (2, 4), (3, 2), (4, 6)])
@pytest.mark.parametrize("depth", [8, 16])
def test_png_of_every_kind_and_filter(channels, colour, depth):
    h, w, top = 13, 9, (1 << depth) - 1
    a = RNG.integers(0, top + 1, (h, w, channels))
    rows = a.astype(">u2" if depth == 16 else "u1").reshape(h, -1).view(np.uint8)
    got = decode(png(w, h, depth, colour, rows, channels * depth // 8, split=3))
    v = a / top
    v = v[..., :-1] * v[..., -1:] if colour in (4, 6) else v
    want = np.repeat(v, 3, -1) if v.shape[-1] == 1 else v
    assert got.shape == (3, h, w) and got.dtype == np.float32 and np.allclose(np.moveaxis(got, 0, -1), eight(want), atol=1e-6)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_png_of_few_bits_and_palettes(depth):
    h, w, top = 6, 11, (1 << depth) - 1
    a = RNG.integers(0, top + 1, (h, w))
    bits = (a[..., None] >> np.arange(depth)[::-1] & 1).reshape(h, -1).astype(np.uint8)
    rows = np.packbits(bits, axis=1)
    assert np.allclose(decode(png(w, h, depth, 0, rows, 1))[1], eight(a / top), atol=1e-6)
    palette = RNG.integers(0, 256, (top + 1, 3)).astype(np.uint8)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0" * 4
    got = decode(png(w, h, depth, 3, rows, 1, extra=part(b"PLTE", palette.tobytes()) + part(b"tRNS", b"\x80")))
    want = palette[a] / 255 * np.where(a == 0, 128 / 255, 1.0)[..., None]
    assert np.allclose(np.moveaxis(got, 0, -1), eight(want), atol=1e-6)


def tiff(order, a, bits=8, packed=1, rows=4, predictor=1, orientation=1, kind=None, extra=None, colours=None):
    h, w, n = a.shape
    kind = kind if kind is not None else 2 if n >= 3 else 1
    sample = order + ("u1" if bits == 8 else "u2")
    strips = []
    for y in range(0, h, rows):
        s = a[y : y + rows].astype(np.int64)
        if predictor == 2:
            s = np.concatenate([s[:, :1], np.diff(s, axis=1)], 1) % (1 << bits)
        raw = s.astype(sample).tobytes()
        if packed == 32773:
            raw = b"".join(bytes([0, b]) for b in raw[:-4]) + bytes([128, 3]) + raw[-4:]  # literals and a no-op
        strips.append(zlib.compress(raw) if packed in (8, 32946) else raw)
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (bits,) * n), (259, 3, (packed,)), (262, 3, (kind,)), (273, 4, None), (274, 3, (orientation,)), (277, 3, (n,)), (278, 4, (rows,)), (279, 4, tuple(map(len, strips))), (317, 3, (predictor,))]
    tags += [(320, 3, tuple(colours))] if colours is not None else []
    tags += [(338, 3, (extra,))] if extra is not None else []
    body, at, offsets = b"", 8, []
    for s in strips:
        offsets.append(at + len(body))
        body += s
    fields, more, more_at = b"", b"", at + len(body)
    for tag, t, v in sorted(tags, key=lambda x: x[0]):
        v = tuple(offsets) if v is None else v
        data = struct.pack(f"{order}{len(v)}{'H' if t == 3 else 'I'}", *v)
        if len(data) > 4:
            fields += struct.pack(order + "HHII", tag, t, len(v), more_at + len(more))
            more += data
        else:
            fields += struct.pack(order + "HHI", tag, t, len(v)) + data.ljust(4, b"\0")
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", more_at + len(more))
    return head + body + more + struct.pack(order + "H", len(tags)) + fields + b"\0" * 4


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits, packed, predictor", [(8, 1, 1), (16, 1, 1), (8, 8, 2), (16, 32946, 2), (8, 32773, 1)])
@pytest.mark.parametrize("n", [1, 3])
def test_tiff(order, bits, packed, predictor, n):
    top = (1 << bits) - 1
    a = RNG.integers(0, top + 1, (10, 7, n))
    got = decode(tiff(order, a, bits, packed, 4, predictor))
    want = np.repeat(a, 3, -1) if n == 1 else a
    assert np.allclose(np.moveaxis(got, 0, -1), eight(want / top), atol=1e-6)


def test_tiff_orientation_inversion_alpha_and_palette():
    a = RNG.integers(0, 256, (4, 6, 1))
    plain = eight(a[..., 0] / 255)
    turned = {1: plain, 2: plain[:, ::-1], 3: plain[::-1, ::-1], 4: plain[::-1], 5: plain.T, 6: plain.T[:, ::-1], 7: plain.T[::-1, ::-1], 8: plain.T[::-1]}
    for k, want in turned.items():
        assert np.allclose(decode(tiff("<", a, orientation=k))[0], want, atol=1e-6), k
    assert np.allclose(decode(tiff("<", a, kind=0))[0], eight(1 - a[..., 0] / 255), atol=1e-6)
    rgba = RNG.integers(0, 256, (4, 6, 4))
    want = rgba[..., :3] / 255 * rgba[..., 3:] / 255
    assert np.allclose(np.moveaxis(decode(tiff(">", rgba, extra=2)), 0, -1), eight(want), atol=1e-6)
    assert np.allclose(np.moveaxis(decode(tiff(">", rgba, extra=1)), 0, -1), eight(rgba[..., :3] / 255), atol=1e-6)
    colours = RNG.integers(0, 65536, (3, 256))
    assert np.allclose(decode(tiff("<", a, kind=3, colours=colours.ravel().tolist())), eight(colours[:, a[..., 0]] / 65535), atol=1e-6)


@pytest.mark.parametrize("data", [b"", b"\xff\xd8\xff\xe0 jpeg", b"nothing", bitmaps.PNG + b"\0" * 30, encode(np.zeros((3, 4, 4)))[:-30], tiff("<", np.zeros((4, 4, 1), int))[:40], tiff("<", np.zeros((4, 4, 1), int), packed=5)])
def test_what_is_not_read_says_so(data):
    with pytest.raises(BitmapError):
        decode(data)


def test_round_trip_and_table(spark, tmp_path):
    a = np.floor(RNG.random((3, 20, 30)) * 255.999) / 255
    assert np.allclose(decode(encode(a + 1e-9)), a, atol=1e-6) and np.allclose(decode(encode(a[:1] + 1e-9))[2], a[0], atol=1e-6)
    (tmp_path / "a.PNG").write_bytes(encode(a + 1e-9))
    (tmp_path / "b.tif").write_bytes(tiff("<", np.full((5, 2, 3), 255)))
    (tmp_path / "c.jpeg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "d.txt").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r for r in bitmaps.frames(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.PNG", "b.tif", "c.jpeg"] and got["c.jpeg"].error == "JPEG isn't read" and (got["b.tif"].width, got["b.tif"].height) == (2, 5)
    assert np.allclose(np.array(got["a.PNG"].planes).reshape(3, 20, 30), a, atol=1e-6) and got["b.tif"].planes == [[1.0] * 10] * 3


def test_shrinking_keeps_area_means():
    a = RNG.random((2, 60, 90))
    half = shrunk(a, 45)
    assert half.shape == (2, 30, 45) and np.allclose(half, a.reshape(2, 30, 2, 45, 2).mean((2, 4)))
    odd = shrunk(a, 64)
    assert odd.shape == (2, 43, 64) and np.allclose(odd.mean((1, 2)), a.mean((1, 2))) and odd.min() >= a.min() and odd.max() <= a.max()
    assert shrunk(a, 90) is a


def test_snapshots_and_latest(spark, tmp_path):
    rows = [(s, k, 8, 4, [(np.full(32, k / 10)).tolist()] * 3, [np.linspace(0, 1, 32).tolist()]) for s in ("a", "b") for k in (1, 2, 10)]
    shots = spark.createDataFrame(rows, "session string, index int, width int, height int, display array<array<double>>, linear array<array<double>>")
    saved = bitmaps.save_snapshots(shots, str(tmp_path), most=4)
    got = {(r.session, r["index"]): r for r in bitmaps.point_to_latest(saved, str(tmp_path)).collect() and saved.collect()}
    r = got["a", 10]
    assert (r.snapshot_file, r.width, r.height) == ("snapshots/0010.png", 8, 4) and abs(r["mean"] - 0.5) < 1e-9 and abs(r["median"] - 16 / 31) < 1e-9
    assert sorted(p.name for p in (tmp_path / "b" / "snapshots").iterdir()) == ["0001.png", "0002.png", "0010.png"]
    latest = decode((tmp_path / "b" / "latest.png").read_bytes())
    assert latest.shape == (3, 2, 4) and np.allclose(latest, 1.0)
