"""License scans against SQL on odd rows and against plain loops with other templates."""

import random
import re

import duckdb
import pytest

from framelake.llm import licenses

from ..compare import assert_same

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons"
ODD = [
    (1, None), (2, ""), (3, " \n\t|"), (4, "under the MIT license under the mit LICENSE cc-by-nc"), (4, "under the MIT license under the mit LICENSE cc-by-nc"), (None, "CC BY NC cc by nc"),
    (5, "ab cd " * 60_000 + MIT + " ef" * 7), (6, "x" * 200_000), (7, "the license " * 20_000), (8, "under the mit\nlicense. Licensed under the GNU Lesser General Public License, version 3"),
    (9, "This work is licensed under the GNU General Public License, version 3."), (10, "licensed under CC BY-NC-SA 4.0 " + "and then " * 30 + "licensed under CC BY 4.0"), (11, "Licensed under the GNU Affero General Public License, version 3"),
    (12, "über the mit license ÀÉ 漢字 under the mit licenseé K İ"), (13, "Licensed under the Apache License, Version 2.0; apache-license version 2 apache license version 20"), (14, "apache licenſe version 2 coKy"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, label string, score double").repartition(3)


def test_odd_rows_equal_sql(spark):
    ours = licenses.digest(frame(spark, ODD)).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ODD)
    assert_same(ours, con.sql(licenses.SQL).df())
    by = {r.doc_id: r for r in ours.itertuples()}
    assert [by[i].labels for i in (3, 5, 8, 9, 11)] == ["", "mit", "lgpl-3,mit", "gpl-3", "agpl-3"]
    assert by[10].labels == "cc-by,cc-by-nc,cc-by-nc-sa" and by[4].n_base == 3 and (by[4].first_word, by[4].last_word) == (0, 8)


def test_no_rows_and_no_templates(spark):
    none = frame(spark, ODD).where("doc_id < 0")
    assert licenses.digest(none).count() == 0 and licenses.find(none).count() == 0
    for templates in ([], [("a", ""), ("b", None)]):
        t = spark.createDataFrame(templates, "label string, text string")
        got = licenses.digest(frame(spark, ODD), t).collect()
        assert len(got) == len(ODD) and all(r.labels == r.base_labels for r in got)


def plain(rows, templates):
    cut = lambda s: re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    out = set()
    for i, text in rows:
        w = cut(text)
        blocks = {}
        for label, t in {(label, tuple(cut(t))) for label, t in templates}:
            s, need = set(t), -(-licenses.CONTAINMENT * len(set(t)) // 100)
            stride = licenses.LEAST_STRIDE
            while stride < len(t):
                stride *= 2
            for k in range(0, -(-len(w) // stride)):
                shared = s & set(w[k * stride : (k + 2) * stride])
                if s and len(shared) >= need:
                    blocks.setdefault((stride, k), []).append((label, shared, len(shared) / len(s)))
        for (stride, k), m in blocks.items():
            for label, shared, c in m:
                if not any(shared <= o and (len(o) > len(shared) or d > c) for _, o, d in m):
                    out.add((i, label, round(c, 9), k * stride, min(len(w), (k + 2) * stride)))
    return out


@pytest.mark.parametrize("seed, rows_broadcast", [(0, 500_000), (1, 500_000), (2, 0)])
def test_join_finds_every_pair_and_no_more(spark, monkeypatch, seed, rows_broadcast):
    """Few words, so that templates overlap, contain each other and tie; with broadcast tables and without."""
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows_broadcast)
    monkeypatch.setattr(licenses, "LEAST_STRIDE", 4)
    monkeypatch.setattr(licenses, "CONTAINMENT", 75)
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.12)), 40)}"
    templates = [(f"t{k % 9}", " ".join(word() for _ in range(rng.randint(1, 14)))) for k in range(14)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    want = plain(rows, templates)
    found = licenses.find(frame(spark, rows), spark.createDataFrame(templates, "label string, text string")).collect()
    assert {(r.doc_id, r.label, round(r.containment, 9), r["from"], r["to"]) for r in found} == want and len(want) > 30


def test_plan_is_native(spark):
    """No Python worker in any plan of the operator."""
    df = licenses.digest(frame(spark, ODD))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
