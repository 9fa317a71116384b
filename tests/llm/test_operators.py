"""Each operator against brute force, on the smallest table and on a table of odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import common, decontaminate, html_text, line_dedup, packing, pii, quality_lm, quality_rules, queries, secrets, simhash, toxicity

from ..compare import assert_same
from ..conftest import DATA

LONG = "abc def " * 20_000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One word"), (4, "One word"), (5, LONG), (6, "x" * 200_000), (7, "a@b.co " * 3 + "1.2.3.4"), (8, "ÀÉ ñ 漢字 😀 token = 'abcdef12' 😀 10.0.0.256 +1 (555) 555-1234"),
    (9, "secret=token: abcdefgh password=ab"), (10, "4111 1111 1111 1111, 4111-1111-1111-1112"), (11, "<|endoftext|> a  b\n\n c  d"), (12, None), (13, "0" * 50_000), (14, "a@" * 5_000), (15, "<p>\r\n|*#"), (None, "no id at all, but words"),
    *((k, "This line is shared by many of the documents here.\nown " + str(k)) for k in range(20, 27)),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -5")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df())


def luhn(d):
    d = [int(c) for c in d[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * v, 10)) for v in d[1::2])) % 10 == 0


def digits(m):
    return re.sub(r"\D", "", m[0])


SECRETS = [
    ("assign", r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def slow(text):
    """Texts on which the plain patterns take quadratic time."""
    return len(text) > 40_000


@pytest.mark.parametrize("op, kinds", [(secrets.digest, SECRETS), (pii.digest, PERSONAL)])
@pytest.mark.parametrize("table", ["docs", "odd"])
def test_base_spans(request, op, kinds, table):
    df = request.getfixturevalue(table)
    want = Counter()
    for i, t in texts(df):
        if not slow(t):
            s = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))
            want[i, *(sum(x[2] == name for x in s) for name, _, _ in kinds), sha(",".join(f"{n}:{a}:{b}" for a, _, n, b in s))] += 1
    rows = op(df).collect()
    assert len(rows) == df.count()
    skip = {i for i, t in texts(df) if slow(t)}
    assert Counter((r.doc_id, *(r[f"n_{k[0]}"] for k in kinds), r.base_sha256) for r in rows if r.doc_id not in skip) == want
    for r in rows:
        assert sha(",".join(x for x in r.spans.split(",") if x and "-" not in x)) == r.base_sha256


def test_secret_battery_tells_random_from_text():
    rng = np.random.default_rng(0)
    random = [secrets.battery(rng.integers(0, 16, 40), 16) for _ in range(200)]
    text = [secrets.battery(np.frombuffer(b"itisatruthuniversallyacknowledgedthatasi", np.uint8).astype(int) % 16, 16)]
    assert np.median(random) < 10 < min(text)
    assert secrets.encoding_of("deadbeef00112233") == "hex" and secrets.encoding_of("onlyletters") is None
    assert secrets.encoding_of("AbCd1234+/xyz") == "base64" and secrets.encoding_of("AB-cd12_x") == "base64url"


def test_secrets_are_discovered_in_a_corpus(spark):
    rng = np.random.default_rng(1)
    words = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    hexes = ["".join(rng.choice(list("0123456789ABCDEF"), 40)) for _ in range(60)]
    rows = [(i, words[i % len(words)][: 400 + i] + (f" key {hexes[i // 20]} end" if i % 20 == 0 else "")) for i in range(1200)]
    found = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("spans like '%random-%'").collect()}
    planted = {i for i in range(1200) if i % 20 == 0}
    assert len(planted & found.keys()) >= 50 and len(found.keys() - planted) <= 2


def test_crf_finds_forms_that_the_patterns_miss(spark):
    df = spark.createDataFrame([(1, "call (555) 123-4567 today"), (2, "in 1999 it cost 12.50"), (3, "tel 555-123-4567.")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert got[1] == "crf-phone:5:19" and got[2] == "" and got[3] == "crf-phone:4:16"


def test_personal_data_on_new_labelled_lines(spark):
    """Base and found spans together against planted ones of lines the chain wasn't trained on; a span counts if it overlaps one of its kind."""
    lines, planted = [], set()
    for i, (tokens, tags) in enumerate(pii.labelled_table(400, seed=99)):
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])])
        lines.append((i, " ".join(tokens)))
        for k, y in enumerate(tags):
            if y[0] == "B":
                end = next((j for j in range(k + 1, len(tags)) if tags[j] != "I" + y[1:]), len(tags))
                planted.add((i, y[2:], int(at[k]), int(at[end]) - 1))
    got = set()
    for r in pii.digest(spark.createDataFrame(lines, "doc_id long, text string")).collect():
        for x in filter(None, r.spans.split(",")):
            kind, a, b = x.split(":")
            got.add((r.doc_id, kind.removeprefix("crf-"), int(a), int(b)))
    meets = lambda x, others: any(x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3] for y in others)
    by_row = lambda spans: {i: [x for x in spans if x[0] == i] for i in range(len(lines))}
    wanted, found = by_row(planted), by_row(got)
    recall, precision = sum(meets(x, found[x[0]]) for x in planted) / len(planted), sum(meets(x, wanted[x[0]]) for x in got) / len(got)
    print(f"planted {len(planted)}, found {len(got)}, recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_viterbi_is_the_best_path():
    chain = pii.train(pii.labelled_table(60))
    rng = np.random.default_rng(0)
    m = chain.move + pii._BARRED
    scores = [rng.normal(0, 2, (n, len(pii.TAGS))) for n in (1, 2, 3)]
    from itertools import product

    for s, got in zip(scores, pii.viterbi(chain, scores)):
        value = lambda p: sum(s[t, k] + m[p[t - 1] if t else 0, k] for t, k in enumerate(p))  # noqa: E731, B023
        assert abs(value(got) - max(value(p) for p in product(range(len(pii.TAGS)), repeat=len(s)))) < 1e-9


def brute_contamination(doc, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, who = words(doc), set(), set()
    for item, t in items:
        v = words(t)
        m = min(13, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit |= set(range(j, j + m))
                    who.add("" if item is None else str(item))
    return len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [10**7, 40])
def test_decontamination(spark, odd, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = [(1, "one WORD"), (2, None), (3, "..."), (10, "own"), (7, "abc def abc def abc def abc def abc def abc def abc def abc"), (7, "many of the documents"), (None, "no id at all")]
    b = spark.createDataFrame(items, "item_id long, text string")
    some = odd.where("doc_id is null or doc_id not in (5, 6, 13, 14)")
    want = Counter((i, *brute_contamination(t, items)) for i, t in texts(some))
    assert Counter(map(tuple, decontaminate.digest(some, b).collect())) == want
    assert Counter(r.contaminated for r in decontaminate.digest(odd.where("doc_id = 5"), b).collect()) == {True: 1}
    assert decontaminate.digest(odd, b.where("item_id < -1")).where("n_hit > 0").count() == 0


def test_wu_manber_equals_scanning():
    rng = np.random.default_rng(3)
    word = lambda n: [b"w%d" % k for k in rng.integers(0, 4, n)]
    for _ in range(40):
        items = [(str(k), b" ".join(word(int(rng.integers(0, 9))))) for k in range(6)]
        text = word(120)
        found, who = decontaminate.WuManber(items, 4).find(text)
        want, owners = set(), set()
        for item, t in items:
            v = t.split()
            m = min(4, len(v))
            for i in range(len(v) - m + 1 if m else 0):
                for j in range(len(text) - m + 1):
                    if text[j : j + m] == v[i : i + m]:
                        want.add((j, j + m))
                        owners.add(item)
        assert set(found) == want and who == owners


def test_decontamination_keeps_clashing_columns(spark):
    docs_ = spark.createDataFrame([(1, "one two three", 7, "x", True), (2, "four five six", 8, "y", None)], "doc_id long, text string, HITS int, items string, contaminated boolean")
    items = spark.createDataFrame([(5, "two three")], "item_id long, text string")
    found = decontaminate.search(docs_, items)
    assert found.columns == [*docs_.columns, "n_words", "_hits", "_items"]
    assert {(r.doc_id, r.HITS, r["items"], len(r._hits)) for r in found.collect()} == {(1, 7, "x", 1), (2, 8, "y", 0)}
    assert [r.asDict() for r in decontaminate.uncontaminated(docs_, items).collect()] == [{"doc_id": 2, "text": "four five six", "HITS": 8, "items": "y", "contaminated": None}]


def test_wu_manber_tables_stay_small():
    rng = np.random.default_rng(0)
    text = b" ".join(b"%x" % k for k in rng.integers(0, 2**24, 100_000))
    t = decontaminate.WuManber([("a", text)]).tables[0]
    held = len(t.text) + len(t.shift) + sum(x.nbytes for x in (t.ends, t.starts, t.hashes, t.places))
    assert held < 8 * len(text)
    assert t.find(text.split()[50:70], found := [], who := set()) is None and len(found) == 8 and who == {"a"}


def test_toxicity_learns_words_and_keeps_clean_text(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghi"), 6)) for _ in range(400)]
    rows, marks = [], []
    for i in range(1500):
        w = [vocabulary[k] for k in rng.integers(0, 400, 60)]
        bad = i % 6 == 0
        if bad:
            for k in rng.integers(0, 60, int(rng.integers(1, 4))):
                w[k] = rng.choice(["zorgly", "mukkow", "xxtra" + rng.choice(list("abcdef"))])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad), 0))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.digest(docs_, spark.createDataFrame(marks, "doc_id long, toxic int, quality int")).collect()}
    for i, bad, _ in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert np.mean([got[i].predicted == bad for i, bad, _ in marks if got[i].held_out]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_odd_rows(odd, none, labels):
    assert toxicity.digest(odd, labels.where("toxic > 5")).where("predicted = 1 or score is null").count() == 0
    marks = labels.limit(0).unionByName(labels.sparkSession.createDataFrame([(4, 1, 1), (20, 1, 0), (21, 0, 0), (22, 0, 1), (99, None, None)], "doc_id long, toxic int, quality int"))
    assert toxicity.digest(odd, marks).count() == len(ODD)
    assert toxicity.digest(none, labels).count() == 0
    assert toxicity.score(odd, toxicity.Model()).columns[: len(odd.columns)] == odd.columns


def brute_simhash(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    least = list(range(len(fps)))
    moved = True
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    while moved:
        moved = False
        for i, j in links:
            m = min(least[i], least[j])
            moved |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    return least


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_simhash(request, table):
    df = request.getfixturevalue(table).where("doc_id is not null and (doc_id not in (6))")
    rows = sorted(texts(df))
    fps = [brute_simhash(t) for _, t in rows]
    root = brute_components(fps)
    want = Counter((i, f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, root))
    assert Counter(map(tuple, simhash.digest(df).collect())) == want
    kept = Counter(r.doc_id for r in simhash.one_of_each(df).collect())
    assert kept == Counter({rows[r][0] for r in root})


@pytest.mark.parametrize("groups", [8, 11])
def test_ball_finds_all_links_and_no_more(groups):
    rng = np.random.default_rng(groups)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 3, 4, 5, 7)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    ball = simhash.Ball(groups)
    assert sum(map(len, ball.masks.values())) == 2081
    found = [e for r in range(2**groups) for e in ball.forest(fps[np.isin(ball.route(fps) ^ r, list(ball.masks))], r)]
    at = {int(f): i for i, f in enumerate(fps)}
    root = np.arange(len(fps))
    pairs = np.array([(at[a], at[b]) for a, b in found]).reshape(-1, 2)
    root = simhash._joined(root, pairs[:, 0], pairs[:, 1])
    assert root.tolist() == brute_components([int(f) for f in fps])


def test_simhash_edges(spark, odd, none):
    assert simhash.digest(none).count() == 0
    got = [r for r in simhash.digest(odd).collect() if r.doc_id is None]
    assert len(got) == 1 and simhash.digest(odd).count() == len(ODD)


@pytest.mark.parametrize("parts", [2, 10, 10_000])
def test_hot_fingerprints_and_hubs(spark, monkeypatch, parts):
    """A third of all rows are copies and a star has many arms: the same result wherever the bound on hot keys is."""
    monkeypatch.setattr(common, "HOT_PARTS", parts)
    rows = [(k, "the same words in every copy of it") for k in range(60)] + [(100 + k, f"text {k} of {k * k} other words {k % 7}") for k in range(100)] + [(None, "")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [brute_simhash(t) for _, t in rows]
    want = Counter((i, f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, brute_components(fps)))
    assert Counter(map(tuple, simhash.digest(df).collect())) == want
    star = spark.createDataFrame([(1000 + k, 5) if k % 2 else (5, 1000 + k) for k in range(200)] + [(k, k + 1) for k in range(20, 40)], "a long, b long")
    got = {r.fp: r.root for r in simhash.components(star).collect()}
    assert got == dict.fromkeys([5, *range(1000, 1200)], 5) | dict.fromkeys(range(20, 41), 20)


def test_one_of_each_without_ids_and_with_repeated_ids(spark, none):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue cyan pink grey")
    rows = [(None, a), (None, a), (None, b), (7, c), (7, c), (7, b + " more words than these"), (9, c)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in simhash.one_of_each(df).collect())
    assert got == Counter([(None, a), (None, b), (7, c), (7, b + " more words than these")])
    assert simhash.one_of_each(df).columns == df.columns and simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.digest(df).toPandas()
    want = Counter()
    for i, text in texts(df):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048))
    none_ = lambda v: None if v != v else int(v)
    assert Counter((none_(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces.itertuples()) == want
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= 2048
    waste = 2048 * pieces["sequence_id"].nunique() - pieces["length"].sum()
    assert waste < 2048 + 0.02 * pieces["length"].sum()


def test_tree_equals_first_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 100, int(rng.integers(0, 60)))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - room[k])
            room[k] -= lengths[i]


def test_sequences_round_trip(docs):
    pieces = packing.digest(docs)
    seq = {r.sequence_id: r.ids for r in packing.sequences(docs, pieces).collect()}
    enc = packing.Encoder()
    text = dict(texts(docs))
    back = {}
    for r in pieces.collect():
        back.setdefault(r.doc_id, {})[r.start] = seq[r.sequence_id][r.offset : r.offset + r.length]
    for i, parts in back.items():
        assert [x for k in sorted(parts) for x in parts[k]] == [*enc.ids(text[i]).tolist(), 1]
    assert all(len(s) == 2048 or len(s).bit_count() == 1 for s in seq.values())


def test_repeated_rows_and_long_documents_spread_over_groups(spark):
    df = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"))
    df = df.union(spark.createDataFrame([(8, "word " * 100_000)], "doc_id long, text string"))
    got = packing.pack(df, group_pieces=1000).withColumn("grp", F.expr("sequence_id >> 32"))
    sizes = [r["count"] for r in got.groupBy("grp").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 2000 and sum(sizes) == got.count() > 30_000
    assert got.where("doc_id = 8").select("grp").distinct().count() > 15


def test_encoder_splits_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    rng = np.random.default_rng(0)
    parts = [" ", " ", " ", "\n", "\t", "  ", "a", "Word", "it's", "12", "é", "漢", "...", " ", " ", "<|endoftext|>", "😀", "\r\n", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 9))))
        assert enc.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_quality_statistics(request, table, labels):
    df = request.getfixturevalue(table)
    want = Counter()
    for i, t in texts(df):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    rows = quality_rules.digest(df, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in rows)


def test_decision_list_is_precise():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5) | (x["b"] > 0.95)
    rules = quality_rules.learn(x, bad)
    caught = np.zeros(3000, bool)
    for r in rules:
        caught |= quality_rules._mask(r, x, 3000)
    assert (caught & ~bad).sum() <= 0.01 * 3000 and (caught & bad).sum() >= 0.95 * bad.sum()
    assert quality_rules.learn(x, np.zeros(3000, bool)) == []


PAGES = [
    (1, "<html><body><nav><a>x</a></nav><article><h1>T</h1><p>One &amp; <b>two</b>\n three<p>four<br>five</article><footer>f</footer></body></html>", "T\nOne & two three\nfour five"),
    (2, None, ""), (3, "", ""), (4, "plain   words only", "plain words only"),
    (5, "<div class='cookie-notice'>We use cookies on this site for you</div><article><p>Body text stands here.</p><div class=\"ad\">Buy a lot of things now</div><p>More.</p></article><div id=comments><p>nice one, thanks a lot</p></div>", "Body text stands here.\nMore."),
    (6, "<article><p>a &lt; b and 3 < 4<script>var s='<p>no</p>'</script> end</p><form><p>name</p></form></article>", "a < b and 3 < 4\nend"),
    (7, "<article><p>cut off in the <b", "cut off in the"),
    (8, "<nav><ul><li><a href=x>only</a></li></ul></nav><style>p{}</style><!-- <p>c</p>", ""),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h, _ in PAGES], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.digest(df.repartition(2)).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, _, t in PAGES}
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())
    assert html_text.digest(df.limit(0)).count() == 0


def test_html_region_is_the_largest_sum():
    rng = np.random.default_rng(0)
    for _ in range(100):
        w = rng.normal(0, 1, 12)
        a, b = html_text.region(w.tolist())
        assert abs(w[a:b].sum() - max([0, *(w[i:j].sum() for i in range(12) for j in range(i + 1, 13))])) < 1e-9


def test_html_region_decides(monkeypatch):
    w = html_text.learn_weights()
    link = lambda k: f"<li><a href=/{k}>Entry {k}</a></li>"
    menu = "<div class='x9'><ul>" + "".join(map(link, range(30))) + "</ul></div>"
    body = "<div class=zz><h1>Head</h1><p>" + "words of the article " * 20 + "</p><p>Last <a href=u>one</a>.</p></div>"
    page = f"<html><body><div>Some offer that stands alone</div>{menu}{body}{menu}<div>All rights reserved here</div></body></html>"
    want = "Head\n" + ("words of the article " * 20).strip() + "\nLast one."
    assert html_text.main_text(page, w) == want
    monkeypatch.setattr(html_text, "region", lambda s: (0, len(s)))
    assert html_text.main_text(page, w) != want


def test_html_weights_are_learned_from_the_pages_given():
    teach = [(f"<body><div class=promo>good words number {k}</div><p>other words {k}</p></body>", f"good words number {k}") for k in range(40)]
    w = html_text.learn_weights(teach)
    by_name = dict(zip(html_text.FEATURES, w.features))
    assert by_name["p"] < 0 < w.word and by_name[".ad"] == 0
    assert html_text.main_text("<body><p>other</p><div class=promo>good</div></body>", w) == "good"


def test_html_is_exact_on_most_new_labelled_pages():
    w = html_text.learn_weights()
    pages = html_text.labelled_pages(200, seed=5)
    assert np.mean([html_text.main_text(p, w) == t for p, t in pages]) > 0.9


def test_html_is_linear_in_long_pages():
    import time

    w = html_text.learn_weights()
    for page in ("<div>" * 100_000 + "x" + "</p>" * 100_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p><table>" + "<b>" * 50_000 + "<li class=ad>x" * 50_000, "<div class=ad>" * 50_000 + "y"):
        began = time.process_time()
        html_text.main_text(page, w)
        assert time.process_time() - began < 2


def test_html_pages_of_the_table(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.digest(pages).collect()}
    for r in pages.collect():
        x = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", y.replace("<br>", " ")))).strip() for y in re.split(r"</?(?:p|h1)>", x)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in t.split("\n"):
                if len(key(line)) >= 40:
                    holders.setdefault(key(line), set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = Counter()
    for i, t in rows:
        lines = t.split("\n")
        left = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out[i, len(lines), len(lines) - len(left), sha("\n".join(left))] += 1
    return out


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("table", ["docs", "odd"])
def test_line_dedup(request, monkeypatch, table, most):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_KEYS", most)
    df = request.getfixturevalue(table)
    assert Counter(map(tuple, line_dedup.digest(df).collect())) == brute_lines(texts(df))


def test_line_dedup_is_reversible(odd, none):
    base = odd.where("doc_id < 24")
    index = line_dedup.LineIndex.of(base)
    assert index.n_dropped == 0
    more = index.insert(odd.where("doc_id >= 24"))
    assert more.n_dropped == 1
    state = lambda x: Counter(map(tuple, x.refs.collect()))
    back = more.delete(odd.where("doc_id >= 24").select("doc_id"))
    assert state(back) == state(index) and back.n_dropped == 0
    assert line_dedup.digest(none).count() == 0


def test_line_index_changes_touch_their_shards_only(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 60)
    line = "A line that stands in a number of the documents, number {}"
    some = docs.where("doc_id % 10 != 3").select("doc_id", "text")
    new = spark.createDataFrame([(10**6 + k, f"{line.format(7)}\n{line.format(8) if k < 4 else ''}") for k in range(6)], "doc_id long, text string")
    index = line_dedup.LineIndex.of(some)
    assert index.shards > 8
    table = lambda x, name: Counter(tuple(r) for r in getattr(x, name).select(*sorted(getattr(x, name).columns)).collect())
    held = lambda x: {r.shard: line_dedup.CuckooFilter.from_bytes(r.filter) for r in x.filters.collect()}
    more = index.insert(new)
    keys = {line_dedup.key_of(line.format(k).encode()) for k in (7, 8)}
    assert set(more.touched) == {k[1] % index.shards for k in keys} and len(more.touched) < 3
    assert more.n_dropped == index.n_dropped + 1 and table(more.insert(new), "counts") == table(more, "counts")
    whole = line_dedup.LineIndex.of(some.unionByName(new))
    for x, y in ((more, whole), (more.delete(new.select("doc_id")), index)):
        assert table(x, "refs") == table(y, "refs")
        want = Counter((r.h1, r.h2, r.keep_doc, r.n_docs) for r in y.counts.collect())
        assert Counter((r.h1, r.h2, r.keep_doc, r.n_docs) for r in x.counts.collect()) == want and x.n_dropped == y.n_dropped
        filters = held(x)
        for r in x.dropped.collect():
            assert filters[r.h2 % x.shards].may_hold(np.array([r.h1])).all()
        assert Counter(map(tuple, x.apply(some).collect())) == Counter(map(tuple, y.apply(some).collect()))
    # Documents that kept a line go: the next largest one keeps it.
    gone = docs.where("doc_id % 2 = 0")
    less = line_dedup.LineIndex.of(docs).delete(gone.select("doc_id"))
    assert Counter(map(tuple, less.dropped.select("h1", "h2", "keep_doc", "n_docs").collect())) == Counter(map(tuple, line_dedup.LineIndex.of(docs.where("doc_id % 2 = 1")).dropped.select("h1", "h2", "keep_doc", "n_docs").collect()))


def test_line_dedup_of_a_hot_line_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 50)
    line = "this very line stands in every document of them"
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\n"), F.col("id").cast("string")).alias("text"), F.lit(3).alias("N_Lines"))
    for most in (10**6, 0):
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST_KEYS", most)
        got = line_dedup.dedup_lines(df)
        assert got.columns == ["doc_id", "text", "N_Lines", "_n_lines", "n_dropped"]
        assert {(r.doc_id, r.text, r.N_Lines, r._n_lines, r.n_dropped) for r in got.collect()} == {(k, f"{line}\n{k}" if k == 299 else str(k), 3, 2, int(k != 299)) for k in range(300)}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys, other = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 20_000)
    f = line_dedup.CuckooFilter(4000)  # too small on purpose: the rest list takes over
    for k in keys.tolist():
        f.add(k)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.may_hold(keys).all() and f.may_hold(other).mean() < 0.01
    for k in keys[:2500].tolist():
        assert f.remove(k)
    assert f.may_hold(keys[2500:]).all() and f.may_hold(keys[:2500]).mean() < 0.01


def test_quality_lm(docs, odd, none, labels):
    rows = quality_lm.digest(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    got = quality_lm.digest(odd, labels.where("quality > 5")).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got)
    assert quality_lm.digest(none, labels).count() == 0


def test_pipeline_stages(spark, docs, odd):
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    lines = corpus_pipeline.dedup_lines(spark, docs, DATA)
    want = Counter((i, h) for i, _, _, h in brute_lines(texts(docs)).elements())
    assert Counter((r.doc_id, sha(r.text)) for r in lines.collect()) == want
    clean = corpus_pipeline.drop_contaminated(spark, docs, DATA)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = {r.doc_id for r in decontaminate.digest(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
    assert {i for i, _ in texts(clean)} == {i for i, _ in texts(docs)} - found and items
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, DATA).count() > 0
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stored_tables_are_deleted_once_results_are_written(spark, tmp_path):
    from pathlib import Path

    from framelake.llm import common

    kept = common.stored(spark.range(3), "kept")
    with common.scratch(spark):
        gone = common.stored(spark.range(5), "gone")
        gone.write.parquet(str(tmp_path / "out"))
    assert Path(kept.stored_at).exists() and not Path(gone.stored_at).exists() and spark.read.parquet(str(tmp_path / "out")).count() == 5
    common.forget(spark, kept.stored_at)
    assert not Path(kept.stored_at).exists()


def test_columns_that_clash_stay(odd):
    out = toxicity.score(odd, toxicity.Model())
    assert out.columns == [*odd.columns, "_score", "predicted"] and out.where("score != 'clash' or _score != 0").count() == 0
    assert toxicity.clean(odd, toxicity.Model()).columns == odd.columns
    taken = odd.withColumns({"n_lines": F.lit("mine"), "_N_LINES": F.lit(2), "hits": F.lit(3)})
    out = line_dedup.dedup_lines(taken)
    assert out.columns == [*taken.columns, "__n_lines", "n_dropped"] and out.where("n_lines != 'mine' or _N_LINES != 2").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(odd.sparkSession, taken, DATA).columns == taken.columns


def brute_label_model(rows, start, share, rounds):
    """The label model in plain Python: rows are sets of voters."""
    n, m = len(rows), len(start)

    def rates_of(rows, r):
        every = [sum(j in v for v in rows) / n for j in range(m)]
        return [[(sum(p[c] for p, v in zip(r, rows) if j in v) + every[j]) / (sum(p[c] for p in r) + 1) for c in range(len(r[0]))] for j in range(m)]

    def em(rows, rates, share):
        for _ in range(rounds):
            r = []
            for v in rows:
                w = [s * math.prod(p[c] if j in v else 1 - p[c] for j, p in enumerate(rates)) for c, s in enumerate(share)]
                r.append([x / sum(w) for x in w])
            toxic = sum(sum(p[1:]) for p in r)
            share = [share[0], *(sum(p[c] for p in r) / toxic * (1 - share[0]) for c in range(1, len(share)))]
            rates = [[max(1e-6, x) for x in p] for p in rates_of(rows, r)]
        return rates, r

    def groups(least):
        group = list(range(m))
        for a in range(m):
            for b in range(m):
                if cov[a][b] >= least * math.sqrt(cov[a][a] * cov[b][b]):
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
        return group

    rates, r = em(rows, start, [1 - share, share])
    left = [[(j in v) - p[0] * rates[j][0] - p[1] * rates[j][1] for j in range(m)] for v, p in zip(rows, r)]
    cov = [[sum(x[a] * x[b] for x in left) for b in range(m)] for a in range(m)]
    one, family = groups(toxicity.CORRELATED), groups(toxicity.RELATED)
    merged = [{one[j] for j in v} for v in rows]
    names = sorted({family[one[j]] for j in range(m)}, key=lambda f: (-sum(p[1] for v, p in zip(merged, r) for j in v if family[j] == f), f))
    split = []
    for v, p in zip(merged, r):
        votes = [sum(family[j] == f for j in v) for f in names] + [0]
        best = [x == max(votes) for x in votes]
        split.append([p[0], *(p[1] * x / sum(best) for x in best)])
    toxic = sum(sum(p[1:]) for p in split)
    _, r = em(merged, [[max(1e-6, x) for x in p] for p in rates_of(merged, split)], [1 - share, *(sum(p[c] for p in split) / toxic * share for c in range(1, len(names) + 2))])
    q = [1 - p[0] for p in r]
    return rates_of(rows, [[1 - x, x] for x in q]), sum(q) / n, q


def votes_of(rng, n, toxic_rates, clean_rates, share=0.3):
    y = rng.random(n) < share
    v = rng.random((n, len(toxic_rates))) < np.where(y[:, None], toxic_rates, clean_rates)
    return y, [np.flatnonzero(x).tolist() for x in v]


def flat(rows):
    return np.array([i for i, r in enumerate(rows) for _ in r]), np.array([j for r in rows for j in r])


def test_label_model_equals_brute_force():
    rng = np.random.default_rng(2)
    _, rows = votes_of(rng, 150, [0.5, 0.4, 0.45, 0.3, 0.2], [0.05, 0.02, 0.1, 0.02, 0.2])
    rows = [sorted({*r, *([1] if 0 in r else [])} - ({1} if 0 not in r else set())) for r in rows]  # voter 1 repeats voter 0
    start = np.tile([0.1, 0.4], (5, 1))
    got = toxicity.label_model(*flat(rows), len(rows), start, 0.3, rounds=20)
    want = brute_label_model(list(map(set, rows)), start.tolist(), 0.3, 20)
    assert np.allclose(got[0], want[0], atol=1e-5) and abs(got[1] - want[1]) < 1e-5 and np.allclose(got[2], want[2], atol=1e-4)


def test_label_model_finds_out_a_bad_voter_and_copies_of_one():
    rng = np.random.default_rng(3)
    y, rows = votes_of(rng, 4000, [0.5, 0.4, 0.45, 0.5, 0.3], [0.03, 0.02, 0.03, 0.02, 0.3])
    # All five are believed to be equally good at first; the last one votes at random. Then the first one has four copies.
    rates, share, q = toxicity.label_model(*flat(rows), len(rows), np.tile([0.05, 0.4], (5, 1)), 0.3)
    assert np.allclose(rates, np.stack([[0.03, 0.02, 0.03, 0.02, 0.3], [0.5, 0.4, 0.45, 0.5, 0.3]], 1), atol=0.1)
    assert abs(share - y.mean()) < 0.05 and ((q > 0.5) == y).mean() > 0.88
    copied = [[*r, *(range(5, 9) if 0 in r else ())] for r in rows]
    rates, share, q = toxicity.label_model(*flat(copied), len(rows), np.tile([0.05, 0.4], (9, 1)), 0.3)
    assert ((q > 0.5) == y).mean() > 0.88 and (rates[5:] == rates[0]).all()


def test_toxicity_on_held_out_rows(spark):
    docs_, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.digest(docs_, marks).join(marks.where("toxic is not null"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
