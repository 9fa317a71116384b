"""Personal data: fixed base patterns, and a linear-chain CRF over word shapes.

The CRF labels tokens O or B-/I- of email, ip, card and phone from the shapes of a token
and its neighbours. It is trained here on a small labelled table (by default written by
rule in ``labelled_table``; any table of tokens and tags serves) by gradient ascent on
the exact log likelihood, and decoded by Viterbi over numpy batches of padded stretches.

A token without a digit or "@" is always O, so a text's tokens fall into independent
stretches between such tokens; every stretch of the whole text is decoded. Base spans
stay as they are; CRF spans that no base span overlaps are added.

Defined cases: null text is empty; spans are code points, end exclusive; repeated rows
are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs: a run of digits is tried once, so very long runs stay linear.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
#: Stretches decoded together.
BATCH = 512
ROUNDS, STEP, L2 = 80, 0.5, 1e-3


def luhn(digits: bytes) -> bool:
    d = [x - 48 for x in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def _emails(raw: bytes) -> list[tuple[int, int]]:
    """As the pattern finds them: for each @, the run of local characters before it."""
    out, last, at = [], 0, raw.find(b"@")
    while at >= 0:
        s = at
        while s > last and raw[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(raw, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            last = m.end()
            at = raw.find(b"@", last)
        else:
            last = at + 1
            at = raw.find(b"@", at + 1)
    return out


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and then kind."""
    out = [(a, b, 0) for a, b in _emails(raw)] if b"@" in raw else []
    for m in _IP.finditer(raw):
        if all(len(x.lstrip(b"0")) <= 3 and int(x.lstrip(b"0") or b"0") <= 255 for x in m[0].split(b".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(raw):
        if m.end() - m.start() >= 12:
            digits = m[0].translate(None, b" -")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 9 <= sum(48 <= x <= 57 for x in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


_TYPES = bytes(100 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1*", re.S)


def shape(token: bytes) -> str:
    """Letter and digit runs with their lengths up to 5, other characters as they are."""
    t = token.translate(_TYPES)
    return "".join(m[1].decode("latin-1") + (str(min(5, len(m[0]))) if m[1] in b"dAa" else "") for m in _RUN.finditer(t))


def features_of(tokens: list[bytes], i: int) -> list[str]:
    t = tokens[i]
    digits = sum(48 <= x <= 57 for x in t)
    at = lambda k: shape(tokens[k]) if 0 <= k < len(tokens) else "|"
    word = lambda k: tokens[k].strip(b".,:;()").lower().decode("utf-8", "replace") if 0 <= k < len(tokens) else "|"
    brief = re.sub(r"\d", "", shape(t))
    return [
        "bias", f"s={shape(t)}", f"b={brief}", f"p={at(i - 1)}", f"n={at(i + 1)}", f"pw={word(i - 1)}", f"digits={min(digits, 20)}", f"len={min(len(t), 24)}",
        f"@={b'@' in t},{t.count(b'.')}", f"+={t[:1] == b'+'}", f"dots={t.count(b'.')},{digits > 3}", f"hyphen={t.count(b'-')},{digits}",
    ]


def is_open(token: bytes) -> bool:
    """Whether a token may be other than O."""
    return b"@" in token or any(48 <= x <= 57 for x in token)


def labelled_table(rows: int = 600, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The default labelled table: tokens and tags of short lines, written by rule."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvwz") for _ in range(r.randint(2, 10)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + x for x in "0123456789" if luhn((body + x).encode()))

    def some() -> list[tuple[str, str]]:
        k = r.random()
        if k < 0.2:
            return [(f"{word()}{r.choice(['.', '_', '', '-'])}{r.choice([word(), d(2)])}@{word()}{r.choice(['', d(1)])}.{r.choice(['example.com', 'com', 'org', 'net', 'co.uk'])}", "B-email")]
        if k < 0.38:
            return [(".".join(str(r.randint(0, 255)) for _ in range(4)), "B-ip")]
        if k < 0.56:
            c = card()
            if r.random() < 0.5:
                return [(c, "B-card")]
            parts = [c[i : i + 4] for i in range(0, 16, 4)]
            return [("-".join(parts), "B-card")] if r.random() < 0.4 else [(p, "I-card" if i else "B-card") for i, p in enumerate(parts)]
        if k < 0.76:
            a, b, c = d(3), d(3), d(4)
            form = r.choice([[f"+{r.choice(['1', '44', '49', '33', '34'])}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{r.randint(1, 99)}{a}{b}{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"0{a}", f"{b}{c}"], [f"0{a}/{b}{c}"]])
            return [(p, "I-phone" if i else "B-phone") for i, p in enumerate(form)]
        # What looks like it and is not: years, prices, versions, dates, amounts, keys, plain numbers.
        return [(r.choice([str(r.randint(1900, 2030)), f"{d(2)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"${d(3)}.{d(2)}", f"{d(1)},{d(3)}", d(r.randint(1, 7)), f"{word()}{d(2)}", f"{d(2)}%", f"{word()}={d(2)}{word()}{d(3)}", f"(c){d(4)}", f"{d(1)}:{d(2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([12, 18, 32, 40]))), f"@{word()}", d(24), f"{d(1)}.{d(1)}", f"{d(4)}."]), "O")]

    out = []
    for _ in range(rows):
        line: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            line += [(word() + r.choice(["", "", ".", ","]), "O") for _ in range(r.randint(0, 4))]
            if r.random() < 0.5:
                line.append((r.choice(["call", "tel", "phone:", "mail", "email:", "card", "ip", "from", "at", "no."]), "O"))
            got = some()
            if r.random() < 0.25:
                got[-1] = (got[-1][0] + r.choice([".", ",", ";"]), got[-1][1])
            line += got
        out.append(([t for t, _ in line], [y for _, y in line]))
    return out


def labelled_frame(spark: SparkSession, rows: int = 600, seed: int = 7) -> DataFrame:
    return spark.createDataFrame(labelled_table(rows, seed), "tokens array<string>, tags array<string>")


@dataclass
class Chain:
    """Weights: emit [feature, tag], move [tag, tag]; starts and ends are O next to the stretch."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def rows(self, tokens: list[bytes], i: int) -> list[int]:
        index = self.index
        return [index[f] for f in features_of(tokens, i) if f in index]


_IS_O = np.zeros(len(TAGS))
_BARRED = np.zeros((len(TAGS), len(TAGS)))
for _a, _ta in enumerate(TAGS):
    for _b, _tb in enumerate(TAGS):
        if _tb[0] == "I" and (_ta == "O" or _ta[2:] != _tb[2:]):
            _BARRED[_a, _b] = -1e9


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def stretches(tokens: list[bytes]) -> list[tuple[int, int]]:
    """[start, end) of the runs of open tokens."""
    out, start = [], None
    for i, t in enumerate([*tokens, b""]):
        if i < len(tokens) and is_open(t):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    return out


def train(table: list[tuple[list[str], list[str]]] | None = None) -> Chain:
    """A chain fitted to the labelled table by batch gradient steps on its likelihood."""
    table = labelled_table() if table is None else table
    index: dict[str, int] = {}
    data = []
    for words, tags in table:
        tokens = [w.encode() for w in words]
        for a, b in stretches(tokens):
            rows = [[index.setdefault(f, len(index)) for f in features_of(tokens, i)] for i in range(a, b)]
            data.append((rows, [TAGS.index(t) for t in tags[a:b]]))
    n_f, k = len(index), len(TAGS)
    emit, move = np.zeros((n_f, k)), np.zeros((k, k))
    g_e, g_m = np.full((n_f, k), 1e-6), np.full((k, k), 1e-6)
    width = len(features_of([b"1"], 0))
    longest = max(len(r) for r, _ in data)
    x = np.zeros((len(data), longest, width), np.int64)
    y = np.zeros((len(data), longest), np.int64)
    live = np.zeros((len(data), longest), bool)
    for i, (rows, tags) in enumerate(data):
        x[i, : len(rows)], y[i, : len(rows)], live[i, : len(rows)] = rows, tags, True
    n = len(data)
    last = live.sum(1) - 1
    each = np.arange(n)
    for _ in range(ROUNDS):
        e = emit[x].sum(2)
        m = move + _BARRED
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0] + m[0]
        for t in range(1, longest):
            alpha[:, t] = e[:, t] + _log_sum(alpha[:, t - 1, :, None] + m, 1)
        for t in range(longest - 2, -1, -1):
            nxt = _log_sum(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], nxt, 0)
        z = _log_sum(alpha[each, last], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        target = np.eye(k)[y] * live[:, :, None]
        d_e = -L2 * n * emit
        np.add.at(d_e, x.ravel(), np.repeat((target - node).reshape(-1, k), width, 0))
        d_m = -L2 * n * move
        first = np.exp(m[0] + (e[:, 0] + beta[:, 0]) - z[:, None])
        d_m[0] += target[:, 0].sum(0) - first.sum(0)
        for t in range(1, longest):
            edge = np.exp(alpha[:, t - 1, :, None] + m + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            d_m -= edge.sum(0)
            np.add.at(d_m, (y[live[:, t], t - 1], y[live[:, t], t]), 1)
        g_e += d_e**2
        g_m += d_m**2
        emit += STEP * d_e / np.sqrt(g_e)
        move += STEP * d_m / np.sqrt(g_m)
    return Chain(index, emit, move)


def viterbi(chain: Chain, scores: list[np.ndarray]) -> list[list[int]]:
    """Best tags of each stretch; scores are [token, tag]. Padded numpy batches by length."""
    out: list[list[int]] = [[] for _ in scores]
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    m = chain.move + _BARRED
    for s in range(0, len(order), BATCH):
        some = order[s : s + BATCH]
        longest = len(scores[some[-1]])
        step = max(1, 4_000_000 // max(1, longest * len(TAGS)))
        for g in range(0, len(some), step):
            ids = some[g : g + step]
            e = np.zeros((len(ids), longest, len(TAGS)))
            for j, i in enumerate(ids):
                e[j, : len(scores[i])] = scores[i]
            best, back = e[:, 0] + m[0], np.zeros((len(ids), longest, len(TAGS)), np.int8)
            ends = np.array([len(scores[i]) for i in ids])
            final = np.where((ends == 1)[:, None], best, -1e18)
            for t in range(1, longest):
                total = best[:, :, None] + m
                back[:, t] = total.argmax(1)
                best = total.max(1) + e[:, t]
                final = np.where((ends == t + 1)[:, None], best, final)
            tags = final.argmax(1)
            for j, i in enumerate(ids):
                k, path = int(tags[j]), []
                for t in range(len(scores[i]) - 1, -1, -1):
                    path.append(k)
                    k = int(back[j, t, k])
                out[i] = path[::-1]
    return out


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_OPEN = np.isin(np.arange(256), [*range(48, 58), 64])
_TRIM = b".,;:!?()[]{}<>\"'"


def _open_tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Starts and ends of all tokens, and the numbers of those that may be other than O."""
    a = np.frombuffer(raw, np.uint8)
    marks = np.flatnonzero(_OPEN[a])
    if not len(marks):
        return None
    inside = np.concatenate([[False], ~_SPACE[a], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.unique(np.searchsorted(starts, marks, "right") - 1)


def find(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(doc_id, base, found): spans as structs start, end, kind in code points."""
    held = docs.sparkSession.sparkContext.broadcast(chain or train())

    def run(chunks):
        model = held.value
        known: dict[tuple, np.ndarray] = {}
        zero = np.zeros(len(TAGS))

        def score(tokens: list[bytes], i: int) -> np.ndarray:
            key = (tokens[i - 1] if i else b"", tokens[i], tokens[i + 1] if i + 1 < len(tokens) else b"")
            got = known.get(key)
            if got is None:
                if len(known) > 50_000:
                    known.clear()
                rows = model.rows(tokens, i)
                got = known[key] = model.emit[rows].sum(0) if rows else zero
            return got

        for chunk in chunks:
            todo, scores = [], []
            bases = []
            for n, (_, raw) in enumerate(chunk):
                bases.append(base_spans(raw) if raw else [])
                got = _open_tokens(raw) if raw else None
                if got is None:
                    continue
                starts, ends, some = got
                for part in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1):
                    a, b = int(part[0]), int(part[-1]) + 1
                    lo, hi = max(0, a - 1), min(len(starts), b + 1)
                    tokens = [raw[starts[k] : ends[k]] for k in range(lo, hi)]
                    todo.append((n, [(int(starts[k]), int(ends[k])) for k in range(a, b)]))
                    scores.append(np.array([score(tokens, k - lo) for k in range(a, b)]))
            found: list[list[tuple]] = [[] for _ in chunk]
            for (n, places), tags in zip(todo, viterbi(model, scores)):
                k = 0
                while k < len(tags):
                    if tags[k]:
                        kind, s = (tags[k] - 1) // 2, places[k][0]
                        while k + 1 < len(tags) and tags[k + 1] and TAGS[tags[k + 1]][0] == "I":
                            k += 1
                        e, raw = places[k][1], chunk[n][1]
                        text = raw[s:e]
                        s, e = s + len(text) - len(text.lstrip(_TRIM.replace(b"(", b""))), e - (len(text) - len(text.rstrip(_TRIM)))
                        if s < e and not any(x < e and s < y for x, y, _ in bases[n]):
                            found[n].append((s, e, kind))
                    k += 1
            for n, (doc_id, raw) in enumerate(chunk):
                yield doc_id, _points(raw, bases[n]), _points(raw, found[n])

    span = "array<struct<start:int,end:int,kind:int>>"
    return map_rows(docs, ["doc_id", "text"], f"doc_id long, base {span}, found {span}", run)


def _points(raw: bytes | None, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Byte spans as code point spans."""
    if not spans:
        return []
    at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(at[s]), "end": int(at[e]), "kind": k} for s, e, k in spans]


def digest(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    out = find(docs, chain)
    names = F.array(*map(F.lit, KINDS), *(F.lit(f"crf-{k}") for k in KINDS))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    text = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ordered = lambda c, add: F.transform(c, lambda s: F.struct(s["start"].alias("start"), (s["kind"] + add).alias("kind"), s["end"].alias("end")))
    every = F.array_sort(F.concat(ordered("base", 0), ordered("found", len(KINDS))))
    return out.select(
        "doc_id", *map(count, range(len(KINDS))),
        F.sha2(F.array_join(F.transform("base", text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, text), ",").alias("spans"),
    )
