"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are computed once. From labelled statistics, sequential
covering grows a conjunction of thresholds for low quality on two thirds of the rows,
prunes it on the rest, removes what it covers and goes on; the result is an ordered
list of Spark conditional expressions over the statistics' columns.

Defined cases: null text has no words and fails the base rule (fewer than 10 words);
rows without a label or with labels other than 0 and 1 teach nothing; without labels of
both kinds the list is empty and only the base rule drops. A list has at most MAX_RULES
rules of MAX_CONDITIONS conditions, each one of THRESHOLDS quantiles of what it splits. Repeated rows are all
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Labelled rows that may teach, in order of a hash of the id.
SAMPLE_ROWS = 40_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 16, 4, 64
#: A rule stays if so much of what it covers is low quality, on rows that did not grow it.
MIN_PRECISION, MIN_COVER = 0.9, 8

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_distinct long"
_SPACES, _SYMBOLS = [bytes([b]) for b in b" \t\n\x0b\x0c\r"], [bytes([b]) for b in b"#*$%&|<>"]
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of size words that occur twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = sum(ids[k : k + n] * m for k, m in enumerate(_MULTIPLIERS[:size]))
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    # equal sums only select windows; their words decide
    maybe = np.flatnonzero(counts[inverse] > 1).tolist()
    windows = [tuple(words[k : k + size]) for k in maybe]
    often = Counter(windows)
    starts = np.array([k for k, w in zip(maybe, windows) if often[w] > 1], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + size] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics_of(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words, lines = text.split(), text.split(b"\n")
    with_word = [x for x in lines if not x.isspace() and x]
    return (
        len(words), len(text.decode()) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
        len(with_word) - len(set(with_word)), repeated_words(words), len(with_word), len(text.translate(None, _NOT_UPPER)),
        text.count(b"!") + text.count(b"?"), len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    def run(chunks):
        for chunk in chunks:
            for doc_id, text in chunk:
                yield doc_id, *statistics_of(text)

    return map_rows(docs, ["doc_id", "text"], f"doc_id long, {STATS}", run)


def features() -> dict[str, Column]:
    """Ratios that rules may test, from the statistics' columns; 0 where nothing is counted."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
        "line_words": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = features()[self.name]
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:.6g}"


def _mask(conditions: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, [x[c.name] >= c.threshold if c.above else x[c.name] <= c.threshold for c in conditions], np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Adds the condition of the largest information gain until nothing good is covered."""
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = bad[on].sum(), (~bad)[on].sum()
        if not n or not p:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            for t in np.unique(np.quantile(v[on], np.linspace(0, 1, THRESHOLDS))):
                for above in (True, False):
                    m = on & (v >= t if above else v <= t)
                    p1, n1 = bad[m].sum(), (~bad)[m].sum()
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        on &= _mask([best], x, len(bad))
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    m = _mask(rule, x, len(bad))
    p, n = int(bad[m].sum()), int((~bad)[m].sum())
    return (p + 1) / (p + n + 2), p + n


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The ordered rules; rows in any order give the same list if x is sorted alike."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        g, t = left & ~third, left & third
        if bad[g].sum() < MIN_COVER:
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        xt = {k: v[t] for k, v in x.items()}
        kept = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, xt, bad[t])[0], default=[])
        if not kept:
            break
        precision, cover = _worth(kept, xt, bad[t])
        whole, _ = _worth(kept, {k: v[left] for k, v in x.items()}, bad[left])
        if cover < MIN_COVER // 3 or min(precision + 1 / (cover + 2), whole) < MIN_PRECISION:
            break
        rules.append(kept)
        left &= ~_mask(kept, x, len(bad))
    return rules


def learn_from(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules from at most SAMPLE_ROWS labelled rows of statistics that pass the base rule."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    sample = stats.where(~base_failed()).join(known, "doc_id").select("doc_id", "quality", *[c.alias(f"_{k}") for k, c in features().items()])
    pdf = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE_ROWS).toPandas()
    bad = pdf["quality"].to_numpy() == 0
    if not len(pdf) or bad.all() or not bad.any():
        return []
    return learn({k: pdf[f"_{k}"].to_numpy(float) for k in features()}, bad)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[list[Condition]]) -> Column:
    """The first rule that holds, as text; null where none does."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(reduce(lambda a, b: a & b, [c.column() for c in r]), F.lit(" and ".join(map(str, r))))
    return out.otherwise(F.lit(None).cast("string"))


def apply_rules(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with base_failed, rule and kept added."""
    out = stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    from .common import stored

    stats = stored(statistics(docs), "quality-stats")
    out = apply_rules(stats, learn_from(stats, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
