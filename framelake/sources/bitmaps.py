"""PNG and plain TIFF as frames, and PNG snapshots.

Bitmaps are display data: three channels in [0, 1] of eight bits each, whatever they were stored as;
grey is all three, transparency lies over black, TIFF's orientation is applied. Not read, and
told so in the error: JPEG, interlaced PNG, TIFF in tiles, in separate planes or compressed
otherwise than by PackBits or deflate.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources import store

FILES = "*.{[pP][nN][gG],[tT][iI][fF],[tT][iI][fF][fF],[jJ][pP][gG],[jJ][pP][eE][gG]}"
BITMAPS = "path string, width int, height int, planes array<array<float>>, error string"
LONG_EDGE = 2560
PNG = b"\x89PNG\r\n\x1a\n"


class BitmapError(ValueError):
    pass


def decode(data: bytes) -> np.ndarray:
    """Pixels [3, y, x] as float32 in [0, 1]."""
    if data[:8] == PNG:
        return eight_bits(*_png(data))
    if data[:4] in (b"II*\0", b"MM\0*"):
        return eight_bits(*_tiff(data))
    if data[:3] == b"\xff\xd8\xff":
        raise BitmapError("JPEG isn't read")
    raise BitmapError("neither PNG nor TIFF")


def eight_bits(a: np.ndarray, top: int, alpha: bool) -> np.ndarray:
    """Samples [y, x, channel] up to top as three channels of 255 steps, over black."""
    v = a.astype(np.float64) / top
    if alpha:
        v = v[..., :-1] * v[..., -1:]
    v = np.repeat(v, 3, -1) if v.shape[-1] == 1 else v
    return (np.floor(np.moveaxis(v, -1, 0) * 255 + 0.5) / 255).astype(np.float32)


# ---- PNG


def _png(data: bytes) -> tuple[np.ndarray, int, bool]:
    at, parts, head, palette, clear = 8, [], None, None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise BitmapError("the file is cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None or not parts:
        raise BitmapError("no image in the PNG")
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced or depth not in (1, 2, 4, 8, 16) or not w or not h:
        raise BitmapError(f"PNG of colour {colour}, depth {depth}, interlace {interlaced} isn't read")
    wide, step = -(-w * channels * depth // 8), max(1, channels * depth // 8)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise BitmapError(str(e)) from e
    if len(raw) < h * (wide + 1):
        raise BitmapError("the file is cut off")
    raw = raw[: h * (wide + 1)].reshape(h, wide + 1)
    rows = unfilter(raw[:, 0], raw[:, 1:].reshape(h, wide // step, step)).reshape(h, wide)
    if depth == 16:
        a = rows.reshape(h, w, channels, 2).astype(np.uint16)
        a = a[..., 0] << 8 | a[..., 1]
    elif depth == 8:
        a = rows.reshape(h, w, channels)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w]
        a = (bits * (1 << np.arange(depth)[::-1])).sum(-1)[..., None]
    if colour != 3:
        return a, (1 << depth) - 1, colour in (4, 6)
    if palette is None or a.max() >= len(palette):
        raise BitmapError("a colour is missing from the palette")
    rgba = np.column_stack([palette, np.full(len(palette), 255, np.uint8)])
    if clear is not None:
        rgba[: len(clear), 3] = clear[: len(palette)]
    return rgba[a[..., 0]], 255, True


def unfilter(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Rows [y, pixel, byte] without their filters.

    A byte depends on those left, above and left above, so all of an antidiagonal are found
    together.
    """
    h, w, step = raw.shape
    if kinds.max(initial=0) > 4:
        raise BitmapError("an unknown filter")
    out = np.zeros((h + 1, w + 1, step), np.int16)
    kinds = kinds.astype(int)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(a), a, b, (a + b) >> 1, paeth])
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode(planes: np.ndarray) -> bytes:
    """A PNG of [channel, y, x] in [0, 1], grey or colour, eight bits."""
    c, h, w = planes.shape
    q = np.floor(np.clip(np.nan_to_num(planes), 0, 1) * 255).astype(np.uint8)
    rows = np.moveaxis(q, 0, -1).reshape(h, w * c)
    up = np.vstack([rows[:1], rows[1:] - rows[:-1]])  # the filter that takes the row above off
    body = np.column_stack([np.full(h, 2, np.uint8), up]).tobytes()
    part = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(body, 6)) + part(b"IEND", b"")


# ---- TIFF

#: Sizes of the field types, and numbers of the tags that are read.
_SIZES = {1: "B", 3: "H", 4: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, ORIENTATION, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, COLOURS, TILES, EXTRA = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279, 284, 317, 320, 322, 338


def _tiff(data: bytes) -> tuple[np.ndarray, int, bool]:
    order = "<" if data[:2] == b"II" else ">"
    try:
        tags = _tags(data, order)
        return _strips(data, order, tags)
    except (struct.error, KeyError, IndexError, zlib.error) as e:
        raise BitmapError(f"a broken TIFF: {e!r}") from e


def _tags(data: bytes, order: str) -> dict[int, tuple[int, ...]]:
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    tags = {}
    for k in range(n):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind in _SIZES:
            form = f"{order}{count}{_SIZES[kind]}"
            size = struct.calcsize(form)
            (start,) = struct.unpack(order + "I", entry[8:12])
            tags[tag] = struct.unpack(form, entry[8 : 8 + size] if size <= 4 else data[start : start + size])
    return tags


def _strips(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> tuple[np.ndarray, int, bool]:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, n, bits = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), tags.get(BITS, (1,))
    packed, kind = one(COMPRESSION, 1), one(PHOTOMETRIC, 1)
    if TILES in tags or one(PLANAR, 1) != 1 and n > 1 or packed not in (1, 8, 32773, 32946) or set(bits) not in ({8}, {16}) or kind not in (0, 1, 2, 3):
        raise BitmapError(f"TIFF of bits {bits}, compression {packed}, kind {kind} isn't read")
    rows, depth = min(one(ROWS, h), h), bits[0]
    parts = []
    for k, (at, size) in enumerate(zip(tags[OFFSETS], tags[COUNTS])):
        strip = data[at : at + size]
        if len(strip) < size:
            raise BitmapError("the file is cut off")
        raw = strip if packed == 1 else packbits(strip) if packed == 32773 else zlib.decompress(strip)
        high = min(rows, h - k * rows)
        a = np.frombuffer(raw, order + ("u1" if depth == 8 else "u2"))
        if len(a) < high * w * n:
            raise BitmapError("the file is cut off")
        a = a[: high * w * n].reshape(high, w, n).astype(np.uint16)
        if one(PREDICTOR, 1) == 2:
            a = np.cumsum(a, axis=1, dtype=np.uint64).astype(np.uint16)
        parts.append(a & ((1 << depth) - 1))
    a = np.concatenate(parts)
    if len(a) != h:
        raise BitmapError("the file is cut off")
    if kind == 3:
        a = np.array(tags[COLOURS], np.uint16).reshape(3, -1).T[a[..., 0]]
        return _turned(a, one(ORIENTATION, 1)), 65535, False
    top = (1 << depth) - 1
    if kind == 0:
        a = np.concatenate([top - a[..., :1], a[..., 1:]], -1)
    colours = 3 if kind == 2 else 1
    alpha = n > colours and one(EXTRA, 0) in (1, 2)
    a = a[..., : colours + alpha]
    if alpha and one(EXTRA, 0) == 1:  # colours are already times alpha, so they lie over black
        a, alpha = a[..., :-1], False
    return _turned(a, one(ORIENTATION, 1)), top, alpha


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _turned(a: np.ndarray, orientation: int) -> np.ndarray:
    if orientation >= 5:
        a = a.swapaxes(0, 1)
    up_down, left_right = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}.get(orientation, (0, 0))
    return a[:: -1 if up_down else 1, :: -1 if left_right else 1]


# ---- as tables


def frames(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """BITMAPS: one row a file, its planes in reading order, or why it can't be read."""

    def run(batches):
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                try:
                    a = decode(bytes(f.content))
                    yield pd.DataFrame({"path": [f.path], "width": [a.shape[2]], "height": [a.shape[1]], "planes": [[p.ravel() for p in a]], "error": [None]})
                except BitmapError as e:
                    yield pd.DataFrame({"path": [f.path], "width": [None], "height": [None], "planes": [None], "error": [str(e)]}).astype({"width": "Int32", "height": "Int32"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, BITMAPS)


def shrunk(planes: np.ndarray, most: int = LONG_EDGE) -> np.ndarray:
    """[channel, y, x] with a long edge of at most so many pixels, each the mean of the area it stands for."""
    scale = most / max(planes.shape[1:])
    if scale >= 1:
        return planes
    for axis in (1, 2):
        n = planes.shape[axis]
        new = max(1, int(np.floor(n * scale + 0.5)))
        total = np.concatenate([np.zeros_like(np.take(planes, [0], axis)), np.cumsum(planes, axis)], axis)
        edge = np.arange(new + 1) * (n / new)
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(3)])
        upto = np.take(total, low, axis) + part * np.take(planes, low, axis)
        planes = np.diff(upto, axis=axis) / (n / new)
    return planes


SAVED = "session string, index int, snapshot_file string, width int, height int, mean double, median double, stddev double"


def save_snapshots(shots: DataFrame, root: str, most: int = LONG_EDGE) -> DataFrame:
    """Writes root/session/snapshots/0001.png for each shot, and tells what a manifest records (SAVED).

    shots: session, index, width, height, display (planes to show) and linear (planes to
    describe; size and statistics are those of its first one). A file appears under its name
    whole; a task that runs again writes the same one.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False):
                show = np.array([np.asarray(p, float) for p in f.display]).reshape(len(f.display), int(f.height), int(f.width))
                name = f"snapshots/{int(f.index):04d}.png"
                store.write(f"{root}/{f.session}/{name}", encode(shrunk(show, most)))
                first = np.asarray(f.linear[0], float)
                out.append((f.session, int(f.index), name, int(f.width), int(f.height), float(first.mean()), float(np.sort(first)[len(first) // 2]), float(first.std())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SAVED.split(", ")])

    return shots.select("session", F.col("index"), "width", "height", "display", "linear").mapInPandas(run, SAVED)


def point_to_latest(saved: DataFrame, root: str) -> DataFrame:
    """Copies each session's snapshot of the highest index over root/session/latest.png: (session, snapshot_file)."""

    def run(batches):
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                data = store.read(f"{root}/{f.session}/{f.snapshot_file}")
                if data is not None:
                    store.write(f"{root}/{f.session}/latest.png", data)
            yield pdf

    newest = saved.groupBy("session").agg(F.max_by("snapshot_file", "index").alias("snapshot_file"))
    return newest.mapInPandas(run, newest.schema)
