"""What a change of a line index reads, and long chains of changes against an index made at once."""

import random
from collections import Counter

from pyspark.sql import functions as F

from framelake.llm import line_dedup
from framelake.llm.line_dedup import LineIndex


def line(k):
    return f"This line has number {k:05d} and is long enough to count"


def state(x):
    held = {r.shard: line_dedup.CuckooFilter.from_bytes(r.filter) for r in x.filters.collect()}
    import numpy as np

    assert all(held[r.h2 % x.shards].may_hold(np.array([r.h1])).all() for r in x.dropped.collect())
    return Counter((r.h1, r.h2, r.keep_doc, r.n_docs) for r in x.counts.collect()), Counter(map(tuple, x.refs.collect())), x.n_dropped


def test_a_change_reads_its_own_folders_only(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 30)
    rng = random.Random(0)
    rows = [(i, "\n".join(line(rng.randint(0, 2000)) for _ in range(12))) for i in range(300)]
    index = LineIndex.of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.shards > 40
    read = []
    real = LineIndex._living

    def living(self, name, only):
        out = real(self, name, only)
        read.append((name, only, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(LineIndex, "_living", living)
    index = index.insert(spark.createDataFrame([(999, line(1)), (7, line(2))], "doc_id long, text string"))
    index.insert(spark.createDataFrame([(1000, line(1))], "doc_id long, text string"))
    index.delete(spark.createDataFrame([(7,)], "doc_id long"))
    assert [(n, len(o)) for n, o, _ in read[:3]] == [("bucket", 2), ("bucket", 1), ("bucket", 1)]
    assert read[3][0] == "shard" and len(read[3][1]) <= 13 and len(read) == 4
    assert all("PartitionFilters: [bucket" in p or "PartitionFilters: [shard" in p or "PartitionFilters: [isnotnull" in p for _, _, p in read)


def test_long_chains_of_changes_equal_an_index_of_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "MAX_LOG", 3)
    monkeypatch.setattr(line_dedup, "MIN_DOCS", 2)
    rng = random.Random(1)
    text = lambda: "\n".join(line(rng.randint(0, 30)) for _ in range(rng.randint(0, 5)))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    docs = {i: text() for i in range(40)}
    index = LineIndex.of(frame(docs), min_docs=2)
    for k in range(6):
        if k % 2:
            gone = rng.sample(sorted(docs), 6) + [12345]
            index = index.delete(spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id long"))
            docs = {i: t for i, t in docs.items() if i not in gone}
        else:
            new = {rng.randint(0, 90): text() for _ in range(6)}
            new = {i: t for i, t in new.items() if i not in docs}
            again = dict(list(docs.items())[:2])  # documents that are there already change nothing
            index = index.insert(frame(new | again))
            docs |= new
        assert len(index.log) <= 3 + 2
        whole = LineIndex.of(frame(docs), min_docs=2)
        assert Counter((r.h1, r.h2, r.keep_doc, r.n_docs) for r in index.counts.collect()) == Counter((r.h1, r.h2, r.keep_doc, r.n_docs) for r in whole.counts.collect())
        assert state(index)[1:] == state(whole)[1:]
    df = frame(docs)
    assert Counter(map(tuple, index.apply(df).collect())) == Counter(map(tuple, whole.apply(df).collect()))


def test_empty_changes(spark):
    some = spark.createDataFrame([(i, line(1)) for i in range(6)], "doc_id long, text string")
    index = LineIndex.of(some)
    none = some.where(F.lit(False))
    for other in (index.insert(none), index.delete(none.select("doc_id")), index.insert(none).delete(none.select("doc_id"))):
        assert state(other) == state(index)
    back = LineIndex.of(none).insert(some)
    assert state(back)[1:] == state(index)[1:] and back.n_dropped == 1
