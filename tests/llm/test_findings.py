"""One test for each settled finding of a review."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from framelake.llm import html_text, quality_lm, quality_rules, secrets, sharded_lm


def brute_kneser_ney(train, order):
    """P of an n-gram (tuple of units), by plain dictionaries."""
    pad = lambda t: [sharded_lm.START] * (order - 1) + [ord(c) for c in t]
    grams = lambda t: [tuple(x[i : i + order]) for x in [pad(t)] for i in range(len(x) - order + 1)]
    levels = {order: Counter(g for t in train for g in grams(t))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, total, left = {}, {}, {}
    for k, level in levels.items():
        n1, n2, n3, n4 = (sum(v == j for v in level.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        cuts[k] = [min(j + 1, max(0.0, v)) for j, v in enumerate(d)]
        total[k], left[k] = defaultdict(float), defaultdict(float)
        for g, v in level.items():
            total[k][g[:-1]] += v
            left[k][g[:-1]] += cuts[k][min(v, 3) - 1]

    def p(g):
        k, h = len(g), g[:-1]
        if not k:
            return 1 / (len(levels[1]) + 1)
        if h not in total[k]:
            return p(g[1:])
        v = levels[k].get(g, 0)
        return ((v - cuts[k][min(v, 3) - 1] if v else 0) + left[k][h] * p(g[1:])) / total[k][h]

    return lambda t: sum(math.log(p(g)) for g in grams(t))


def test_sharded_model_sums_to_one(spark):
    """Of any history, seen or not, over all units seen in training and one for those never seen."""
    train = ["the cat sat on the mat", "that hat", "aaaa bb"]
    units = sorted(set("".join(train))) + ["\u2603"]
    histories = ["the ", "", "at", "zzzz", "aaaa", "xthe"]
    rows = [(t, True) for t in train] + [(h + u, False) for h in histories for u in units]
    p = {bytes(r.gram): r.p for r in sharded_lm.model(sharded_lm.gram_counts(spark.createDataFrame(rows, "text string, train boolean"))).collect()}
    for h in histories:
        points = [[*[sharded_lm.START] * 4, *map(ord, h), ord(u)][-sharded_lm.ORDER :] for u in units]
        assert abs(sum(p[b"".join(x.to_bytes(3, "big") for x in g)] for g in points) - 1) < 1e-9, h


def test_repetition_is_low_quality_however_likely(spark):
    rng = np.random.default_rng(0)
    words = ["sun", "rain", "over", "hills", "and", "rivers", "slowly", "falls", "the", "light", "of", "evening"]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(200)] + [(1000 + i, (words[i] + " ") * 60) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_lm.digest(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")), labels).collect()}
    assert sum(got[i].kept for i in range(200)) >= 195 and not any(got[1000 + i].kept for i in range(10))
    assert all(got[1000 + i].variety < got[1000 + i].least_variety for i in range(10))


def test_quality_model_is_sharded_kneser_ney_of_code_points(spark):
    train = ["the cat sat on the mat", "это просто текст", "漢字 かな 漢字", "the dog sat", "a\0b 😀"]
    other = ["the rat sat", "просто кот", "仮名 漢字", "", None, "the rat sat", "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]
    rows = [(i, t, i < len(train)) for i, t in enumerate(train + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    shards = sharded_lm.model(sharded_lm.gram_counts(df))
    got = {r.doc_id: r for r in sharded_lm.scores(df, shards, ("doc_id",)).collect()}
    want = brute_kneser_ney(train, sharded_lm.ORDER)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        padded = [None] * 4 + list(t or "")
        assert got[i].n_units == len(t or "") and got[i].n_distinct == len({tuple(padded[k : k + 5]) for k in range(len(t or ""))})
        assert math.isclose(got[i].log_sum, want(t or ""), rel_tol=1e-5, abs_tol=1e-5), t
    assert shards.select("gram").distinct().count() == shards.count()
    labels = spark.createDataFrame([(i, 1) for i in range(len(train))], "doc_id long, quality int")
    out = quality_lm.digest(df.withColumn("lang", F.lit("x")), labels).collect()
    assert len(out) == len(rows) and any(r.kept for r in out) and not next(r for r in out if r.doc_id == len(rows) - 1).kept


def test_secret_null_covers_whole_texts_and_copies_count_once(spark):
    rng = np.random.default_rng(3)
    x = rng.choice(26, (200, 24), p=np.arange(1, 27) / 351)
    for size, stats in secrets.batteries(x).items():
        assert np.allclose(stats, [secrets.battery(r * size // 26, size) for r in x], rtol=1e-5, atol=1e-5)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    plain = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    key = "".join(rng.choice(list("0123456789ABCDEF"), 40))
    rows = [(i, t + (f" {key} " if i < 6 else "")) for i, t in enumerate(plain)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = lambda d: sorted(map(tuple, secrets.ordinary(d).where("len = 0").groupBy("size").agg(F.sum("m")).collect()))
    once = count(df)
    letters = sum(len(secrets._letters(t.encode())) for _, t in rows)
    assert all(letters / 20 < n < letters / 16 + len(rows) for _, n in once)
    copied = df.unionAll(df.where("doc_id = 9").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(140)))))
    a, b = (secrets.ordinary(d).groupBy("size", "len").agg(F.sum("m").alias("m")).collect() for d in (df, copied))
    total = lambda rows: sum(r.m for r in rows)
    assert total(a) == total(b)
    # A small table finds its secrets.
    found = {r.doc_id for r in secrets.digest(df).where("spans like '%random-%'").collect()}
    assert found == set(range(6))


def test_secrets_of_one_class_and_between_separators_reach_the_battery(spark):
    rng = np.random.default_rng(4)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = [draw("etaoinshrdlu", rng.integers(2, 9)) for _ in range(3000)]
    makers = [lambda: "key-" + draw(lower + digit, 32), lambda: "hf_" + draw(lower + digit, 40), lambda: draw(digit, 40), lambda: "state/" + draw(lower + digit, 36) + "/of-the-art"]
    rows = []
    for i in range(120):
        body = " ".join(rng.choice(words, 300))
        rows.append((i, body + " " + (makers[i % 4]() if i < 40 else "state-of-the-art-and-so-on") + " end"))
    found = {r.doc_id for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("spans like '%random-%'").collect()}
    # Forty digits are the least telling: letters spread over ten symbols look nearly as even.
    least = (9, 9, 3, 9)
    assert all(len(found & set(range(k, 40, 4))) >= least[k] for k in range(4)) and len(found - set(range(40))) <= 2, found
    assert [secrets.alphabet_of(x) for x in ("onlyletters", "ab-cd", "1234", "ABcd12+/-")] == ["lower", "separated", "digits", "separated"]


def test_secret_battery_takes_runs_of_any_length():
    for x in (np.zeros(5000, int), np.full(200_000, 25), np.arange(3000) % 2 * 25):
        assert secrets.battery(x, 26) > 1000


def test_ordinary_letters_of_a_very_long_run_take_linear_time():
    import time

    began = time.process_time()
    assert len(secrets._letters(b"x" * 2_000_000)) == 2_000_000 and len(secrets._letters(b"x" * 2_000_000 + b"1 abc")) == 3
    assert time.process_time() - began < 2


def test_html_wrappers_and_unclosed_boilerplate():
    w = html_text.learn_weights()
    text = "<h1>Head line</h1><p>" + "many words of the article " * 12 + "</p>"
    want = "Head line\n" + ("many words of the article " * 12).strip()
    for tag in ("div class='content has-sidebar'", "div id='page' class='site menu-open'", "section class='post social'", "div class='social'"):
        assert html_text.main_text(f"<body><nav>a b</nav><{tag}>{text}</{tag.split()[0]}></body>", w) == want
    body = "Main text of this page goes on and on"
    assert html_text.main_text(f"<div><p class='ad'>Buy<p>{body}</div>", w) == body
    assert html_text.main_text(f"<table><tr><td class=sidebar>Buy<td>{body}</table>", w) == body
    assert "Buy" not in html_text.main_text(f"<ul><li class=menu>Buy<ul><li>Buy more</ul><li>{body}</ul>", w)
    assert html_text.main_text(f"<body><div class='ad'>Buy this</div><p>{body}</p></body>", w) == body


def test_windows_with_equal_sums_are_not_repeats(monkeypatch):
    """Sums select windows only; with all of them equal the words still decide."""
    words = [b"w%d" % k for k in range(40)]
    monkeypatch.setattr(quality_rules, "_MULTIPLIERS", np.zeros(5, np.uint64))
    assert quality_rules.repeated_words(words) == 0
    assert quality_rules.repeated_words(words + words[3:9]) == 12
