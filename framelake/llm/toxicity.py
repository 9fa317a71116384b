"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters are proposed by document frequency alone: every word and word beginning in the
   sampled rows that enough of them hold, and fixed pattern voters. Labels of training
   rows only orient them: a term that doesn't stand out in toxic rows abstains for good.
   A word of a text votes by the longest term it has.
2. A generative model (EM over the votes, no labels) estimates each voter's rate of voting
   in either class, and the class share. From its posterior the correlations of voters
   given the class are estimated. Voters of nearly the same votes are made one. Voters that
   vote together more than the class explains (such as the words of one language) form
   families, and the model is estimated again with a toxic class for each family.
3. A logistic classifier is trained on the model's posterior labels and scores every
   whole text with one look-up a word. Labels of training rows set its scale and offset.

Rows that teach are a bounded sample (``SAMPLE_ROWS`` of each class, by a hash of the id),
whose words are written once; near copies among them teach once. Only rows whose crc32 of
the id modulo 5 is not 0 teach anything; labels, lang, source and doc_id are never inputs
of a score.

Defined cases: null and empty texts score like a text without words (the class share
when nothing votes); rows without a label, or with a null label, teach nothing; labels
that disagree for one doc_id count each; without labels of both classes every score is
0 and nothing is toxic. Repeated rows are all returned. Columns of docs named like those
added stay; the added ones get a leading underscore.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, held_out, map_rows, stored

#: Labelled rows that may teach, of each class, taken in order of a hash of the id.
SAMPLE_ROWS = 20_000
#: Rows that must hold a proposed term, and prefix lengths.
MIN_ROWS, PREFIXES = 4, range(3, 9)
#: Standard deviations by which toxic rows must exceed their share among those that hold a term, and the least ratio of its rates in the two classes.
ORIENTED, LIFT = 4.5, 5
#: Correlations given the class from which on two voters are of one family, and one; the share of toxic votes that gives a family a class of its own.
RELATED, CORRELATED, FAMILY_SHARE = 0.1, 0.5, 0.02
#: A-Z lowered; bytes that are no part of a word become spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Possessive runs from word starts only: a run of any length is tried once.
_PATTERNS = (
    (re.compile(rb"(?:(?<![A-Za-z])[A-Za-z]{2,}+[!?]{2,}+\s*+){3}"), "shouts"),
    (re.compile(rb"(?<![A-Z])[A-Z]{4,}+(?:[^A-Za-z]++[A-Z]{3,}+){4}"), "capitals"),
    (re.compile(rb"([#*$%&])\1{2,}"), "symbols"),
)
#: Numbers of different voting words that are features of their own.
_COUNTS = (1, 2, 3)


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(WORDS).split())


def terms_of(word: bytes) -> list[str]:
    """The word and its beginnings (ending in *), the longest first."""
    s = word.decode("utf-8", "replace")
    return [s, *(s[:k] + "*" for k in reversed(PREFIXES) if k <= len(s))]


@dataclass
class Model:
    """Weights of the linear classifier over lexicon terms, pattern voters and counts of voting words."""

    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1e9
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    share: float = 0.0

    def features(self, known: dict, words: set[bytes], patterns: list[int]) -> list[int]:
        found: set[int] = set()
        voting = 0
        for w in words:
            hit = known.get(w, -2)
            if hit == -2:
                if len(known) > 300_000:
                    known.clear()
                hit = known[w] = next((self.terms[t] for t in terms_of(w) if t in self.terms), -1)
            if hit >= 0:
                voting += 1
                found.add(hit)
        n = len(self.terms)
        m = n + len(_PATTERNS)
        return sorted(found) + [n + k for k in patterns] + [m + k for k, c in enumerate(_COUNTS) if voting >= c]

    def score(self, known: dict, text: bytes | None) -> float:
        if not len(self.weights):
            return 0.0
        z = self.bias + float(self.weights[self.features(known, words_of(text), patterns_of(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def patterns_of(text: bytes | None) -> list[int]:
    return [k for k, (p, _) in enumerate(_PATTERNS) if p.search(text or b"")]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, words, patterns) of at most SAMPLE_ROWS labelled training rows of each class, one for each group of near copies of a class.

    Copies agree in two of the three least hashes of their long words.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").where(~held_out()).distinct()
    # The sample is chosen among ids alone, so no text is sorted.
    ids = docs.where(~held_out()).select("doc_id").distinct()
    have = known.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit("sample")))
    sample = have.where("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE_ROWS).union(have.where("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").select("toxic", "text")

    def read(chunks):
        for chunk in chunks:
            for toxic, text in chunk:
                words = words_of(text)
                long = [w for w in words if len(w) >= 8] or list(words) or [b""]
                least = [min(zlib.crc32(w, seed) for w in long) for seed in (0, 77, 7777)]
                yield toxic, [w.decode("utf-8", "replace") for w in sorted(words)], patterns_of(text), *least

    found = stored(map_rows(rows, ["toxic", "text"], "toxic int, words array<string>, patterns array<int>, u long, v long, w long", read), "toxicity-words")
    for a, b in (("u", "v"), ("v", "w"), ("u", "w")):
        # Whole rows are compared, so the one that stays doesn't depend on the order.
        found = found.groupBy("toxic", a, b).agg(F.min(F.struct("words", "patterns", "u", "v", "w")).alias("s")).select("toxic", "s.*")
    return stored(found.select("toxic", "words", "patterns"), "toxicity-sample")


def propose(sample: DataFrame) -> dict[str, tuple[int, int]]:
    """Terms that enough rows hold and that labels orient towards toxic: (toxic rows, other rows) where each votes.

    A term is oriented by the rows where it is the longest of a word; what a term that
    falls away held goes to the next shorter one.
    """
    size = dict(sample.groupBy("toxic").count().collect())
    if not size.get(1) or not size.get(0):
        return {}
    total = size[0] + size[1]
    base = size[1] / total

    def counting(chunks):
        counts: dict[str, list[int]] = {}
        for chunk in chunks:
            for toxic, words in chunk:
                for t in {t for w in words for t in terms_of(w.encode() if isinstance(w, str) else w)}:
                    counts.setdefault(t, [0, 0])[toxic] += 1
                if len(counts) > 500_000:
                    yield from ((t, b, a) for t, (a, b) in counts.items())
                    counts.clear()
        yield from ((t, b, a) for t, (a, b) in counts.items())

    counted = map_rows(sample, ["toxic", "words"], "term string, pos long, neg long", counting).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = F.col("pos") + F.col("neg")
    proposed = counted.where(n >= MIN_ROWS)
    stands_out = (F.col("pos") - n * base) / F.sqrt(n * (base * (1 - base)))
    lift = F.col("pos") / size[1] / ((F.col("neg") + 1) / size[0])
    best = proposed.withColumn("z", stands_out).where((F.col("z") >= ORIENTED) & (lift >= LIFT) & (F.col("pos") >= MIN_ROWS))
    # Every term that stands out votes; their number is bounded by the sample's words.
    found = {r["term"]: (r["pos"], r["neg"]) for r in best.collect()}
    # A beginning whose rows are all a longer beginning's, and a word whose rows are all its longest beginning's, add nothing.
    longest = lambda t: t[: PREFIXES[-1]] + "*"
    idle = {t[:-2] + "*" for t, c in found.items() if t.endswith("*") and found.get(t[:-2] + "*") == c}
    idle |= {t for t, c in found.items() if not t.endswith("*") and found.get(longest(t)) == c}
    return _oriented(sample, sorted(found.keys() - idle), base)


def _oriented(sample: DataFrame, terms: list[str], base: float) -> dict[str, tuple[int, int]]:
    number = {t: k for k, t in enumerate(terms)}

    def run(chunks):
        for chunk in chunks:
            for toxic, words in chunk:
                chains = {tuple(number[t] for t in terms_of(w.encode() if isinstance(w, str) else w) if t in number) for w in words}
                yield toxic, sorted(map(list, chains - {()}))

    # A row's chains: for each of its words the terms it has, the longest first. Bounded by the sample.
    got = map_rows(sample, ["toxic", "words"], "toxic int, chains array<array<int>>", run).where("size(chains) > 0").collect()
    rows = [(r["toxic"], [tuple(c) for c in r["chains"]]) for r in got]
    alive = set(range(len(terms)))
    while True:
        votes = np.zeros((len(terms), 2), np.int64)
        for toxic, chains in rows:
            for k in {next((k for k in c if k in alive), -1) for c in chains} - {-1}:
                votes[k, toxic] += 1
        n = votes.sum(1)
        z = (votes[:, 1] - n * base) / np.sqrt(np.maximum(n, 1) * (base * (1 - base)))
        lift = votes[:, 1] / base / ((votes[:, 0] + 1) / (1 - base))
        falls = {k for k in alive if votes[k, 1] < MIN_ROWS or z[k] < ORIENTED or lift[k] < LIFT}
        # The longest of those that fall go first, so that the shorter ones are judged with what they left.
        most = max((len(terms[k]) for k in falls), default=0)
        if not falls:
            return {terms[k]: (int(votes[k, 1]), int(votes[k, 0])) for k in alive}
        alive -= {k for k in falls if len(terms[k]) == most}


def label_model(row: np.ndarray, voter: np.ndarray, n: int, start: np.ndarray, share: float, rounds: int = 40) -> tuple[np.ndarray, float, np.ndarray]:
    """(rates [voter, class], class share, posterior) by EM over votes (row, voter) of n rows, without labels.

    start are the rates to begin with; share, the toxic rows' part of all, is given. The
    order of rows and votes doesn't matter.
    """
    m = len(start)
    rates, r = _em(row, voter, n, np.clip(start, 1e-6, 0.5), np.array([1 - share, share]), rounds)
    i, j, alike = _correlations(row, voter, n, r[:, 1], rates)
    one, family = (_groups(m, i[alike >= least], j[alike >= least]) for least in (CORRELATED, RELATED))
    both = np.unique(np.stack([row, one[voter]], 1), axis=0)
    # A toxic class for each family with its share of the toxic votes, and one for all others.
    size = np.bincount(family[both[:, 1]], r[both[:, 0], 1], m)
    first = [f for f in np.argsort(-size, kind="stable").tolist() if size[f] > 0 and size[f] >= FAMILY_SHARE * size.sum()]
    number = np.full(m, len(first))
    for k, f in enumerate(first):
        number[family == f] = k
    votes = np.zeros((n, len(first) + 1))
    np.add.at(votes, (both[:, 0], number[both[:, 1]]), 1)
    toxic = (votes == votes.max(1, keepdims=True)) * (r[:, 1:] + 1e-3)
    r = np.concatenate([r[:, :1], toxic / toxic.sum(1, keepdims=True) * r[:, 1:]], 1)
    part = np.concatenate([[1 - share], r[:, 1:].sum(0) / max(1e-9, r[:, 1:].sum()) * share])
    _, r = _em(both[:, 0], both[:, 1], n, _rates(both[:, 0], both[:, 1], n, m, r), part, rounds)
    q = 1 - r[:, 0]
    return _rates(row, voter, n, m, np.stack([1 - q, q], 1)), float(q.mean()), q


def _rates(row: np.ndarray, voter: np.ndarray, n: int, m: int, r: np.ndarray) -> np.ndarray:
    """Rates [voter, class] given the rows' classes r, with one row more in each class, where each voter votes as often as in all rows."""
    every = np.bincount(voter, minlength=m) / n
    return np.clip(np.stack([(np.bincount(voter, c[row], m) + every) / (c.sum() + 1) for c in r.T], 1), 1e-6, 1 - 1e-6)


def _em(row: np.ndarray, voter: np.ndarray, n: int, rates: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rates, the rows' classes) after so many rounds."""
    for _ in range(rounds):
        on, off = np.log(rates), np.log(1 - rates)
        z = np.stack([np.log(max(1e-6, s)) + b.sum() + np.bincount(row, (a - b)[voter], n) for s, a, b in zip(share, on.T, off.T)], 1)
        r = np.exp(z - z.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        # The clean part stays as given; toxic classes share the rest.
        share = np.concatenate([share[:1], r[:, 1:].sum(0) / max(1e-9, r[:, 1:].sum()) * (1 - share[0])])
        rates = _rates(row, voter, n, len(rates), r)
    return rates, r


def _correlations(row: np.ndarray, voter: np.ndarray, n: int, q: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, correlation given the class) of the voters i < j that vote together somewhere; no others correlate positively.

    Sums of (vote - expected vote) products, multiplied out: only votes given together are
    counted by pair, and no table of all pairs is held.
    """
    m = len(rates)
    order = np.lexsort((voter, row))
    row, voter = row[order], voter[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(starts, len(row)))
    held, waiting = [], 0
    for k in np.unique(size[size > 1]).tolist():
        # Rows of equally many votes at a time, in parts of some millions of pairs.
        a, b = np.triu_indices(k, 1)
        of_size = starts[size == k]
        for part in np.array_split(of_size, 1 + len(of_size) * len(a) // 4_000_000):
            votes = voter[part[:, None] + np.arange(k)]
            held.append(np.unique((votes[:, a] * m + votes[:, b]).ravel(), return_counts=True))
            waiting += len(held[-1][0])
            if waiting > 20_000_000:
                held = [_added(held)]
                waiting = len(held[0][0]) // 2
    pair, together = _added(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    i, j = pair // m, pair % m
    clean, toxic = rates.T
    on_clean, on_toxic = np.bincount(voter, 1 - q[row], m), np.bincount(voter, q[row], m)
    cc, ct, tt = ((1 - q) ** 2).sum(), (q * (1 - q)).sum(), (q * q).sum()

    def products(i: np.ndarray, j: np.ndarray, together: np.ndarray) -> np.ndarray:
        crossed = on_clean[i] * clean[j] + on_toxic[i] * toxic[j] + on_clean[j] * clean[i] + on_toxic[j] * toxic[i]
        return together - crossed + clean[i] * clean[j] * cc + (clean[i] * toxic[j] + toxic[i] * clean[j]) * ct + toxic[i] * toxic[j] * tt

    every = np.arange(m)
    own = np.sqrt(np.maximum(products(every, every, np.bincount(voter, minlength=m)), 1e-9))
    return i, j, products(i, j, together) / (own[i] * own[j])


def _added(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in counted]), len(keys)).astype(np.int64)


def _groups(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's connected group, for links between i and j."""
    group = np.arange(m)
    while True:
        least = group.copy()
        np.minimum.at(least, i, group[j])
        np.minimum.at(least, j, group[i])
        least = least[least]
        if (least == group).all():
            return group
        group = least


def _logistic(row: np.ndarray, feature: np.ndarray, m: int, q: np.ndarray, steps: int = 600, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum on soft labels, classes balanced; features are 0/1 at (row, feature).

    Each weight's step is scaled by its curvature, so rare features are learned as fast as frequent ones.
    """
    n = len(q)
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    each = np.where(q > 0.5, 0.5 / max(1, (q > 0.5).sum()), 0.5 / max(1, (q <= 0.5).sum()))
    pace = 0.05 / (np.bincount(feature, each[row], m) / 4 + l2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature], n) + b, -30, 30)))
        g = each * (p - q)
        vw, vb = 0.9 * vw - pace * (np.bincount(feature, g[row], m) + l2 * w), 0.9 * vb - 0.2 * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def _calibration(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """(scale, offset) of the logits that fit the labels best, by Newton's method; the scale stays positive."""
    x, w = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, x.T @ (y - p) - 0.1 * (w - [1.0, 0.0])), -1, 1)
    return max(1e-3, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = training_rows(docs, labels)
    proposed = propose(sample)
    if not proposed:
        return Model()
    terms = sorted(proposed)
    model = Model({t: k for k, t in enumerate(terms)})

    def run(chunks):
        known: dict = {}
        for chunk in chunks:
            for toxic, words, patterns in chunk:
                yield toxic, model.features(known, set(map(str.encode, words)), list(patterns))

    # Features of the bounded sample: small integer lists, counted by pattern.
    got = map_rows(sample, ["toxic", "words", "patterns"], "toxic int, features array<int>", run).groupBy("toxic", "features").count().orderBy("toxic", "features").collect()
    rows = [(r["toxic"], r["features"]) for r in got for _ in range(r["count"])]
    y, n, m = np.array([t for t, _ in rows]), len(rows), len(terms) + len(_PATTERNS)
    row = np.repeat(np.arange(n), [len(f) for _, f in rows])
    feature = np.array([k for _, f in rows for k in f], np.int64)
    start = np.full((m, 2), 0.01)
    start[: len(terms)] = [((proposed[t][1] + 1) / (n - y.sum() + 2), (proposed[t][0] + 1) / (y.sum() + 2)) for t in terms]
    voting = feature < m
    model.rates, model.share, q = label_model(row[voting], feature[voting], n, start, float(y.mean()))
    w, b = _logistic(row, feature, m + len(_COUNTS), q)
    scale, offset = _calibration(np.bincount(row, w[feature], n) + b, y)
    model.weights, model.bias = w * scale, b * scale + offset
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added; one narrow pass over whole texts."""
    return beside(docs, ("score", "predicted"), lambda d: _score(d, model))


def _score(docs: DataFrame, model: Model) -> DataFrame:
    from pyspark.sql import types as T

    keep = docs.columns
    fields = docs.schema.fields
    strings = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    at = keep.index("text")

    def run(chunks):
        known: dict = {}
        for chunk in chunks:
            for row in chunk:
                s = model.score(known, row[at])
                values = list(row)
                for i in strings:
                    values[i] = None if values[i] is None else values[i].decode()
                yield *values, s, int(s >= 0.5)

    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_rows(docs, keep, schema, run)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs."""
    out = score(docs, model)
    return out.where(F.col(out.columns[-1]) == 0).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)

    # The text goes into the pass and does not come out of it.
    def run(chunks):
        known: dict = {}
        for chunk in chunks:
            for doc_id, text in chunk:
                s = model.score(known, text)
                yield doc_id, s, int(s >= 0.5)

    out = map_rows(docs.select("doc_id", "text"), ["doc_id", "text"], "doc_id long, score double, predicted int", run)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
