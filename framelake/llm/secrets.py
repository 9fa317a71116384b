"""Secret scans: fixed base patterns, and a randomness battery under false-discovery control.

Every stretch of 16 or more key characters is a candidate, and so is each of its parts
between "-", "_" and "/" that is as long. Its encoding (hex, base32, base36, base64, one
class of characters, or words with separators) is inferred and three tests for uniform
random symbols are made: chi-squared of the alphabet, runs above and below the
alphabet's middle, and serial correlation at lag one. Fisher's method combines them
into one statistic; low means random.

What the statistic is for ordinary text of that length and alphabet is measured on all
documents: every distinct text once, cut from end to end into stretches of each length
class; runs with a digit are no ordinary text. A candidate's p-value is the
share of ordinary stretches of its length class at most as high, and Benjamini and
Hochberg's procedure is run within each size of alphabet and length class. Short strings, where
text looks random too, thus need a lower statistic than long ones.

Defined cases: null text is empty; spans are code points, end exclusive; repeated rows
are all returned; an empty table gives no rows; with no ordinary stretches in a class
nothing is found there.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROWS_AT_ONCE, map_rows, stored

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, so asking for 24 in the pattern finds the runs that a later check would keep.
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = (b"passw", b"secret", b"token", b"key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}")
KINDS = ("assign", "access", "hex")
#: Share of false discoveries allowed in a class, and the lower ends of the length classes.
FDR, LENGTHS = 0.05, (16, 20, 24, 32, 48, 96)
_ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase, "BASE36": string.digits + string.ascii_uppercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
    "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digits": string.digits, "separated": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_",
}
ENCODINGS = tuple(_ALPHABETS)
#: Encodings that mix classes; the others have a null of their own size.
_MIXED = ENCODINGS[:7]
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in _ALPHABETS.items()}
SIZES = tuple(sorted({len(v) for v in _ALPHABETS.values()}))
_STEP, _TOP = 20, 2000


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base patterns."""
    out = []
    if any(h in (low := raw.translate(LOWER)) for h in _HINTS):
        del low
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)])


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token; None unless classes mix."""
    chars = set(token)
    upper, lower, digit = (bool(chars.intersection(x)) for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
    if upper + lower + digit < 2 or chars & {"-", "_"} and not (upper and lower and digit):
        return None
    return next((k for k in _MIXED if chars <= _INDEX[k].keys()), None)


def alphabet_of(token: str) -> str:
    """encoding_of(), or the alphabet of one character class or of separated words."""
    chars = set(token)
    return encoding_of(token) or next((k for k in ("digits", "lower", "upper") if chars <= _INDEX[k].keys()), "separated")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of key characters, and of their parts between separators."""
    out = []
    for m in _CANDIDATE.finditer(text):
        out.append(m.span())
        out += [p for p in ((m.start() + q.start(), m.start() + q.end()) for q in _PART.finditer(m[0])) if p != m.span()]
    return out


def _normal_tail(z: float) -> float:
    return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))


def battery(x: np.ndarray, size: int) -> float:
    """Fisher's statistic of the three tests that x is uniform over range(size)."""
    n = len(x)
    counts = np.bincount(x, minlength=size)
    # All symbols count even where few are expected; the statistic's true variance there gives its degrees of freedom.
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    chi, free = float(((counts - n / size) ** 2).sum()) * size / n * 2 * mean / var, 2 * mean * mean / var
    cube = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    p_chi = max(1e-300, 0.5 * math.erfc(cube / math.sqrt(2)))
    high = x * 2 >= size
    a = int(high.sum())
    b = n - a
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = _normal_tail((runs - mean) / math.sqrt(var))
    else:
        p_runs = max(1e-300, 2.0 ** (1 - n))
    c = x - x.mean()
    total = float((c * c).sum())
    p_serial = _normal_tail((float((c[1:] * c[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 1e-300
    return -2 * (math.log(p_chi) + math.log(p_runs) + math.log(p_serial))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def _bin(stat: float) -> int:
    return min(_TOP, int(stat * _STEP))


#: Repeated texts' hashes (8 bytes each) that are broadcast; more are joined by shuffle.
MAX_BROADCAST_HASHES = 4_000_000
#: Whole runs, so that each is looked at once however long it is.
_RUN, _DIGIT = re.compile(rb"[A-Za-z0-9+/_-]{16,}+"), re.compile(rb"[0-9]")


def _letters(raw: bytes) -> np.ndarray:
    """The letters of the text's ordinary runs, as ranks 0-25."""
    part = np.frombuffer(_RUN.sub(lambda m: b"" if _DIGIT.search(m[0]) else m[0], raw).translate(LOWER), np.uint8)
    return part[(part >= 97) & (part <= 122)] - np.uint8(97)


def _erfc(z: np.ndarray) -> np.ndarray:
    """erfc, to a relative error of 1.2e-7 (Chebyshev fit)."""
    a = np.abs(z)
    t = 1 / (1 + a / 2)
    fit = np.zeros_like(t)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        fit = fit * t + c
    out = t * np.exp(-a * a - 1.26551223 + t * fit)
    return np.where(z < 0, 2 - out, out)


def batteries(x: np.ndarray) -> dict[int, np.ndarray]:
    """battery() of each row of letter ranks, spread over each size of alphabet."""
    m, n = x.shape
    letters = np.bincount((np.arange(m)[:, None] * 26 + x).ravel(), minlength=26 * m).reshape(m, 26).astype(np.float64)
    high = x >= 13
    a = high.sum(1).astype(float)
    b = n - a
    both = 2 * a * b / n
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    var = np.maximum(1e-9, both * (both - 1) / (n - 1))
    p_runs = np.where((a > 0) & (b > 0), np.maximum(1e-300, _erfc(np.abs(runs - 1 - both) / np.sqrt(2 * var))), 2.0 ** (1 - n))
    out = {}
    for size in SIZES:
        spread = np.arange(26) * size // 26
        counts = letters if size >= 26 else letters @ np.eye(size)[spread]
        mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
        chi, free = ((counts * counts).sum(1) - n * n / size) * size / n * 2 * mean / var, 2 * mean * mean / var
        cube = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
        p_chi = np.maximum(1e-300, 0.5 * _erfc(cube / math.sqrt(2)))
        # Sums of whole numbers under 2**24: exact in single precision.
        v = spread.astype(np.float32)[x]
        s1 = v.sum(1, dtype=np.float64)
        mid = s1 / n
        total = np.einsum("ij,ij->i", v, v) - s1 * mid
        lag = np.einsum("ij,ij->i", v[:, 1:], v[:, :-1]) - mid * (2 * s1 - v[:, 0] - v[:, -1]) + (n - 1) * mid * mid
        some = total > 1e-6
        p_serial = np.where(some, np.maximum(1e-300, _erfc(np.abs(lag / np.where(some, total, 1) + 1 / n) * math.sqrt(n / 2))), 1e-300)
        out[size] = -2 * (np.log(p_chi) + np.log(p_runs) + np.log(p_serial))
    return out


def ordinary(docs: DataFrame) -> DataFrame:
    """(size, len, bin, m): ordinary stretches of all lengths over each distinct text, counted within tasks first."""
    keyed = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("h"))
    again = stored(keyed.groupBy("h").count().where("count > 1").select("h"), "secret-repeated")
    again = F.broadcast(again) if again.count() <= MAX_BROADCAST_HASHES else again
    texts = keyed.join(again, "h", "left_anti").select("text").unionAll(keyed.join(again, "h", "left_semi").select("text").dropDuplicates(["text"]))

    def run(batches):
        total = np.zeros((len(SIZES), len(LENGTHS), _TOP + 1), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                held = [_letters(t) for t in b.column(0).slice(at, ROWS_AT_ONCE).cast(pa.binary()).to_pylist()]
                for k, least in enumerate(LENGTHS):
                    for more in range(4):
                        n = least + more
                        # Whole stretches, and one that ends with the text.
                        parts = [y for x in held if len(x) >= n and len(x) % 4 == more for y in (x[: len(x) // n * n], x[len(x) - n :] if len(x) % n else x[:0])]
                        rows = np.concatenate(parts).reshape(-1, n) if parts else ()
                        for z in range(0, len(rows), 1 << 14):
                            for j, stat in enumerate(batteries(rows[z : z + (1 << 14)]).values()):
                                total[j, k] += np.bincount(np.minimum(_TOP, (stat * _STEP).astype(np.int64)), minlength=_TOP + 1)
        j, k, bins = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(SIZES)[j], pa.int32()), pa.array(k, pa.int32()), pa.array(bins, pa.int32()), pa.array(total[j, k, bins])], names=["size", "len", "bin", "m"])

    return texts.mapInArrow(run, "size int, len int, bin int, m long").groupBy("size", "len", "bin").agg(F.sum("m").alias("m"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base array, candidates array): one row for each row of docs."""

    def run(chunks):
        for chunk in chunks:
            for doc_id, raw in chunk:
                raw = raw or b""
                text = raw.decode()
                found = []
                for start, end in candidates(text):
                    e = alphabet_of(token := text[start:end])
                    idx = _INDEX[e]
                    x = np.fromiter((idx[c] for c in token), np.int64, len(token))
                    found.append({"start": start, "end": end, "enc": ENCODINGS.index(e), "size": len(idx), "len": length_class(len(x)), "bin": _bin(battery(x, len(idx)))})
                yield doc_id, [{"start": a, "end": b, "kind": k} for a, b, k in base_spans(text, raw)], found

    span = "struct<start:int,end:int,kind:int>"
    cand = "struct<start:int,end:int,enc:int,size:int,len:int,bin:int>"
    return map_rows(docs, ["doc_id", "text"], f"doc_id long, base array<{span}>, candidates array<{cand}>", run)


def limits(scanned: DataFrame, plain: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """The highest bin that is a discovery, for each size of alphabet and length class.

    Counts by (size, length class, bin) come from all documents; that table is
    bounded by its keys.
    """
    found = scanned.select(F.explode("candidates").alias("c")).groupBy("c.size", "c.len", "c.bin").agg(F.count("*").alias("n"))
    rows = found.join(plain, ["size", "len", "bin"], "full").na.fill(0, ["n", "m"]).collect()
    out = {}
    for key in {(r["size"], r["len"]) for r in rows}:
        n, m = np.zeros(_TOP + 1, np.int64), np.zeros(_TOP + 1, np.int64)
        for r in rows:
            if (r["size"], r["len"]) == key:
                n[r["bin"]], m[r["bin"]] = r["n"], r["m"]
        if not m.sum() or not n.sum():
            continue
        p_value = (1 + np.cumsum(m)) / (1 + m.sum())
        passed = np.flatnonzero((n > 0) & (p_value <= fdr * np.cumsum(n) / n.sum()))
        if len(passed):
            out[key] = int(passed.max())
    return out


def find(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base spans and found spans (start, end, enc), one row for each row of docs."""
    scanned = stored(scan(docs), "secret-scan")
    most = limits(scanned, ordinary(docs), fdr)
    keys = F.create_map(*[F.lit(x) for (n, k), v in sorted(most.items()) for x in (n * 100 + k, v)]) if most else F.lit(None).cast("map<int,int>")
    hits = F.filter("candidates", lambda c: F.coalesce(c["bin"] <= F.try_element_at(keys, c["size"] * 100 + c["len"]), F.lit(False)))
    return scanned.select("doc_id", "base", F.transform(hits, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["enc"].alias("enc"))).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    out = find(docs)
    kinds = F.array(*map(F.lit, KINDS))
    encs = F.array(*(F.lit(f"random-{e}") for e in ENCODINGS))
    n = len(KINDS)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    base = F.transform("base", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    every = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), (s["enc"] + n).alias("kind"), s["end"].alias("end"))),
    ))
    names = F.concat(kinds, encs)
    spans = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"),
    )
