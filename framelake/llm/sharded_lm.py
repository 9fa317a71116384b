"""Interpolated modified Kneser-Ney model of subwords, kept in sharded tables throughout.

Units are code points as they are, neither folded nor hashed; an n-gram is a piece of up
to five of them. Counts, continuation counts, discounts, back-offs and probabilities are
tables keyed by n-gram or history; only four counts of counts a level reach the driver.

Scoring joins with the shards: rows travel in pieces (about 32 million characters, compressed),
each piece's distinct n-grams are joined with the model once, and the probabilities are
brought back to the piece, where its texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, forget, stored

ORDER = 5
#: Stands before a text; no code point.
START = 0x110000
#: Bytes of a unit in a key, bits of its number inside a piece, characters of a piece, keys held by a counting task.
_WIDTH, _BITS, PIECE_UNITS, _HELD = 3, 12, 32 << 20, 1 << 20


class Letters:
    """Numbers of the code points met so far; at most 4,096 with the start, which is 0."""

    def __init__(self) -> None:
        self.points = [START]
        self.number = np.full(START, -1, np.int32)

    def add(self, x: np.ndarray) -> bool:
        """False, and nothing added, if they don't all fit."""
        new = np.unique(x[self.number[x] < 0])
        if len(self.points) + len(new) > 1 << _BITS:
            return False
        self.number[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points += new.tolist()
        return True

    def keys(self, texts: list[np.ndarray]) -> np.ndarray:
        """The n-gram that ends at each unit of the texts, starts padded."""
        pad = np.zeros(ORDER - 1, np.int64)
        x = np.concatenate([y for t in texts for y in (pad, self.number[t].astype(np.int64))]) if texts else pad
        out = np.zeros(len(x) - ORDER + 1, np.int64)
        for k in range(ORDER):
            out = out << _BITS | x[k : len(x) - ORDER + 1 + k]
        return out[x[ORDER - 1 :] > 0]

    def spell(self, keys: np.ndarray) -> pa.Array:
        points = np.array(self.points, np.uint32)
        return _bytes(np.stack([points[keys >> _BITS * (ORDER - 1 - k) & (1 << _BITS) - 1] for k in range(ORDER)], 1))


def _bytes(points: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(np.stack([points >> 16, points >> 8 & 255, points & 255], 2).astype(np.uint8))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_WIDTH * ORDER), len(points), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _units(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode("utf-32-le", "replace"), "<u4") for t in texts.to_pylist()]


def _wide(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as rows of units) and each unit's, of one text with more kinds of code points than Letters holds."""
    x = np.concatenate([np.full(ORDER - 1, START, np.uint32), units])
    return np.unique(np.lib.stride_tricks.sliding_window_view(x, ORDER), axis=0, return_inverse=True)


def _slices(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(k, ROWS_AT_ONCE)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of every n-gram of (text, train); n counts rows to train on and may be 0. Summed within tasks first."""

    def run(batches):
        letters, parts, held = Letters(), [], 0

        def rows(grams, n):
            for k in range(0, len(n), 10_000):
                yield pa.RecordBatch.from_arrays([grams[k : k + 10_000], pa.array(n[k : k + 10_000])], names=["gram", "n"])

        def flush():
            nonlocal letters, parts, held
            if parts:
                keys, n = _merged(parts)
                yield from rows(letters.spell(keys), n)
            letters, parts, held = Letters(), [], 0

        for b in _slices(batches):
            units, train = _units(b.column(0)), b.column(1).to_pylist()
            groups = [list(range(len(units)))]
            if units and not letters.add(np.concatenate(units)):
                groups = [[i] for i in groups[0]]
            for g in groups:
                own = [units[i] for i in g]
                if len(g) < len(units) and not letters.add(own[0]):
                    yield from flush()
                    if not letters.add(own[0]):
                        grams, at = _wide(own[0])
                        yield from rows(_bytes(grams), np.bincount(at.ravel(), minlength=len(grams)) * int(train[g[0]]))
                        continue
                at, keys = pd.factorize(letters.keys(own))
                parts.append((keys, np.bincount(at, np.repeat([float(train[i]) for i in g], [len(x) for x in own]), len(keys))))
                held += len(keys)
                if held > _HELD:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > _HELD // 2:
                        yield from flush()
                    else:
                        held = len(parts[0][0])
        yield from flush()

    return docs.select("text", "train").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> list[float]:
    c = dict(level.where("n between 1 and 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (float(c.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return [min(k, max(0.0, v)) for k, v in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 0.75), (3, 3 - 4 * y * n4 / n3 if n3 else 0.9))]


def model(counts: DataFrame) -> DataFrame:
    """(gram, p): P(last unit | those before) of every n-gram of counts, seen in training or not."""
    level, parts, levels = counts, [], []
    for k in range(ORDER, 0, -1):
        level = stored(level, f"lm-{k}")
        levels.append(level.stored_at)
        d = _discounts(level)
        cut = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        grams = level.select("gram", "n", cut.alias("cut"), F.substring("gram", 1, _WIDTH * (k - 1)).alias("hist"), F.substring("gram", _WIDTH + 1, _WIDTH * (k - 1)).alias("rest"))
        parts.append(grams)
        level = level.groupBy(F.substring("gram", _WIDTH + 1, _WIDTH * (k - 1)).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n"))
    # The last history is empty: two sums and the number of units seen, one share of which is for units never seen.
    total, left, kinds = parts[-1].agg(F.sum("n"), F.sum("cut"), F.count_if(F.col("n") > 0)).first()
    total, left, kinds = float(total or 1), float(left or 0) if total else 1.0, (kinds or 0) + 1
    p = parts[-1].select("gram", ((F.col("n") - F.col("cut") + F.lit(left / kinds)) / F.lit(total)).alias("p"))
    for grams in reversed(parts[:-1]):
        hist = grams.where("n > 0").groupBy("hist").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        lower = p.select(F.col("gram").alias("rest"), F.col("p").alias("lower"))
        own = F.coalesce((F.col("n") - F.col("cut")) / F.col("total"), F.lit(0.0))
        p = grams.join(hist, "hist", "left").join(lower, "rest").select("gram", (own + F.coalesce(F.col("left") / F.col("total"), F.lit(1.0)) * F.col("lower")).alias("p"))
    p = stored(p, "lm")
    forget(p.sparkSession, *levels)
    return p


def pieces(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(piece, rows): docs' columns and text in compressed pieces, numbered by their content."""

    def run(batches):
        held, size, letters = [], 0, Letters()

        def flush():
            nonlocal held, size, letters
            if held:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(pa.Table.from_batches(held).combine_chunks())
                raw = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(raw) - (1 << 63)]), pa.array([raw], pa.binary())], names=["piece", "rows"])
            held, size, letters = [], 0, Letters()

        for b in _slices(batches):
            units = _units(b.column(len(columns)))
            parts = [(b, np.concatenate(units))] if letters.add(np.concatenate(units)) else [(b.slice(i, 1), u) for i, u in enumerate(units)]
            for part, u in parts:
                if not letters.add(u):
                    yield from flush()
                    if not letters.add(u):
                        held = [part]
                        yield from flush()
                        continue
                held.append(part)
                size += len(u)
                if size >= PIECE_UNITS:
                    yield from flush()
        yield from flush()

    return docs.select(*columns, "text").mapInArrow(run, "piece long, rows binary").repartition("piece")


def _read(raw: bytes) -> tuple[pa.Table, Letters | None]:
    t = pa.ipc.open_stream(raw).read_all()
    letters = Letters()
    for b in _slices(t.to_batches()):
        if not letters.add(np.concatenate(_units(b.column(t.num_columns - 1)))):
            return t, None
    return t, letters


def _chunks(t: pa.Table) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in _slices(t.to_batches()):
        yield b, _units(b.column(t.num_columns - 1))


def _distinct(t: pa.Table, letters: Letters) -> np.ndarray:
    parts, held = [], 0
    for _, units in _chunks(t):
        parts.append(pd.unique(letters.keys(units)))
        held += len(parts[-1])
        if held > _HELD:
            parts = [np.unique(np.concatenate(parts))]
            held = len(parts[0])
    return np.unique(np.concatenate(parts))


def _kinds(which: np.ndarray, size: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Different n-grams of each text of a chunk: places that no later one of the same text repeats. last is scratch space."""
    out, end = np.zeros(len(size), np.int64), np.cumsum(size)
    for i, (a, b) in enumerate(zip(end - size, end)):
        own, place = which[a:b], np.arange(a, b)
        last[own] = place
        out[i] = np.count_nonzero(last[own] == place)
    return out


def scores(docs: DataFrame, shards: DataFrame, columns: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """columns, n_units, log_sum and n_distinct (different n-grams) of each row, by joining each piece's distinct n-grams with the shards."""

    def ask(batches):
        for b in batches:
            for piece, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t, letters = _read(raw)
                grams = letters.spell(_distinct(t, letters)) if letters else _bytes(_wide(_units(t.to_batches()[0].column(len(columns)))[0])[0])
                for k in range(0, len(grams), 10_000):
                    g = grams[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([piece] * len(g), pa.int64()), pa.array(np.arange(k, k + len(g), dtype=np.int32)), g], names=["piece", "at", "gram"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_units long, log_sum double, n_distinct long"

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for raw in left.column("rows").to_pylist():
            t, letters = _read(raw)
            keys = pd.Index(_distinct(t, letters)) if letters else None
            n = len(keys) if letters else len(_wide(_units(t.to_batches()[0].column(len(columns)))[0])[0])
            p = np.full(n, np.nan)
            p[right.column("at").to_numpy()] = np.log(right.column("p").to_numpy())
            if np.isnan(p).any():
                raise ValueError("n-grams of a piece are missing from the shards")
            last = np.zeros(n, np.int64)
            for b, units in _chunks(t):
                which = keys.get_indexer(letters.keys(units)) if letters else _wide(units[0])[1].ravel()
                size = np.array([len(u) for u in units])
                log_sum = np.bincount(np.repeat(np.arange(len(units)), size), p[which], len(units))
                out.append(pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size.astype(np.int64)), pa.array(log_sum), pa.array(_kinds(which, size, last))], names=[*columns, "n_units", "log_sum", "n_distinct"]))
        return pa.Table.from_batches(out)

    held = pieces(docs, list(columns))
    asked = held.mapInArrow(ask, "piece long, at int, gram binary")
    found = asked.join(shards, "gram").select("piece", "at", F.col("p").cast("float").alias("p"))
    return held.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(answer, schema)
