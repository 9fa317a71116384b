"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words. The blocks of a text are windows of its words, twice as long
as a stride and a stride apart; a template is held against the blocks of the smallest
stride, 16 or a larger power of two, that has room for all its words, so every place as
long as the template lies whole in one block. A block carries a template if it contains
CONTAINMENT percent of its words. All such pairs are found:

* words are ordered by how often they stand in all texts, rarest first;
* prefix filter: a pair shares one of the first ``size - needed + 1`` words of both sides,
  so blocks are only made where a text has a prefix word of a template;
* length filter: a block with fewer words of the templates than needed can't match;
* positional filter: the shared words so far and what is left after the last of them, on
  the shorter side, must reach what is needed; the rest is compared word by word.

Within a block a match gives way to another one that shares all the words it shares and
more, or the same words at a higher containment. Everything is DataFrame code. Two passes read the texts (word
counts, then blocks); what follows them are small rows of blocks. The templates are the
caller's; prefix words, at most a tenth of theirs and one each, are literals of the second
pass, and the tables made from them are broadcast up to BROADCAST_ROWS rows and joined by
shuffle beyond.

Defined cases: a null text has no words; a text without words has no places and a score of
0; repeated rows and null ids are all returned, one row each; no templates, or templates
without words, find nothing; an empty table gives no rows. Very long texts are one row like
any other. Columns of documents other than doc_id and text play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Per cent of a template's distinct words that a block must contain.
CONTAINMENT = 90
LEAST_STRIDE = 16
#: Tables made from the templates are broadcast up to so many rows (a few dozen bytes each).
BROADCAST_ROWS = 500_000

WORD, NO_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that always count, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and opening passages of well-known licenses, with their labels.
TEMPLATES = [
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
]


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased.

    lower() also changes other letters, which no word rule or ASCII template can see, but for
    the two that it would turn into ASCII letters.
    """
    plain = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("�")), "Kİ", F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(F.lower(plain), NO_WORD), "")


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in TEMPLATES))
    return spark.range(1).select(F.inline(rows))


def base(joined: Column, n_words: Column) -> dict[str, Column]:
    """Places of PHRASES in words joined by two spaces, with one before and after; null has none."""
    count = lambda s, of: (F.length(s) - F.length(F.replace(s, F.lit(of), F.lit("")))) / len(of)
    n, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        one = f" {phrase.replace(' ', '  ')} "
        there = F.contains(joined, F.lit(one))
        n.append(F.when(there, count(joined, one)).otherwise(0).cast("long"))
        first.append(F.when(there, count(F.substring_index(joined, one, 1), " ") / 2).cast("long"))
        last.append(F.when(there, n_words - phrase.count(" ") - 1 - count(F.substring_index(joined, one, -1), " ") / 2).cast("long"))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": reduce(lambda a, b: a + b, n),
        "first_word": F.least(*first),
        "last_word": F.greatest(*last),
        "_base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def order_templates(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """template, label, stride, needed and words (n, token), rarest in all texts first. Stored."""
    t = templates.select("label", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    t = t.select("label", F.size("w").alias("length"), F.array_sort(F.array_distinct("w")).alias("w")).distinct()
    # words alone name a template of one label, so that nothing depends on the order of rows
    t = t.withColumn("template", F.sha2(F.concat_ws(" ", "label", "length", F.concat_ws(" ", "w")), 256))
    each = stored(t.select("template", "label", "length", F.explode("w").alias("token")), "license-templates")
    vocabulary = each.select("token").distinct()
    counts = docs.select(F.explode(words(F.col("text"))).alias("token")).join(bounded(vocabulary, each.count()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    out = (
        each.join(counts, "token", "left").groupBy("template", "label", "length")
        .agg(F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("words"))
        .withColumn("needed", F.expr(f"({CONTAINMENT} * size(words) + 99) div 100").cast("int"))
        .withColumn("stride", F.greatest(F.lit(LEAST_STRIDE), F.pow(F.lit(2), F.ceil(F.log2("length")))).cast("int"))
    )
    return stored(out, "license-order")


def bounded(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _prefix() -> Column:
    return F.slice("words", 1, F.size("words") - F.col("needed") + 1)


def blocks(w: Column, prefixes: dict[int, list[str]]) -> Column:
    """Of a text's words, the blocks (stride, block number, distinct words) that hold a prefix word of their stride."""
    none = F.array().cast("array<struct<stride:int,block:int,tokens:array<string>>>")
    if not prefixes:
        return none
    made = F.concat(none, *(_blocks(w, stride, tokens) for stride, tokens in sorted(prefixes.items())))
    return F.when(F.arrays_overlap(w, F.lit(sorted({x for t in prefixes.values() for x in t}))), made).otherwise(none)


def _blocks(w: Column, stride: int, tokens: list[str]) -> Column:
    at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(tokens), i)), lambda i: i.isNotNull())
    in_two = F.flatten(F.transform(at, lambda i: F.array(F.floor(i / stride).cast("int"), F.floor(i / stride).cast("int") - 1)))
    return F.transform(
        F.filter(F.array_distinct(in_two), lambda k: k >= 0),
        lambda k: F.struct(F.lit(stride).alias("stride"), k.alias("block"), F.array_distinct(F.slice(w, k * stride + 1, F.lit(2 * stride))).alias("tokens")),
    )


def read_texts(docs: DataFrame, ordered: DataFrame) -> DataFrame:
    """Each row's doc_id, counts, base places and candidate blocks, with a row number of its own. Stored."""
    prefixes: dict[int, list[str]] = {}
    for r in ordered.select("stride", F.explode(_prefix()).alias("p")).select("stride", "p.token").distinct().collect():
        prefixes.setdefault(r.stride, []).append(r.token)
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    telling = F.lit(sorted({max(p.split(), key=len) for p in PHRASES}))
    joined = F.when(F.arrays_overlap("w", telling), F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")))
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), joined.alias("joined"))
    rows = rows.select("doc_id", "n_words", blocks(F.col("w"), prefixes).alias("blocks"), *[c.alias(k) for k, c in base(F.col("joined"), F.col("n_words")).items()])
    return stored(rows.withColumn("_row", F.monotonically_increasing_id()), "license-blocks")


def matches(rows: DataFrame, ordered: DataFrame) -> DataFrame:
    """All pairs of a block and a template that it carries: _row, stride, block, label, shared and containment."""
    n_words = ordered.agg(F.sum(F.size("words"))).first()[0] or 0
    counts = ordered.select(F.explode("words").alias("x")).select("x.*").distinct()
    block = ["_row", "stride", "block"]
    tokens = rows.select("_row", F.inline("blocks")).select(*block, F.explode("tokens").alias("token"))
    sets = tokens.join(bounded(counts, n_words), "token").groupBy(*block).agg(F.array_sort(F.collect_set(F.struct("n", "token"))).alias("b"))
    index = ordered.select("template", "label", "stride", "needed", F.col("words").alias("t"), F.posexplode(_prefix()).alias("i", "x"))
    paired = (
        sets.select(*block, "b", F.posexplode("b").alias("j", "x"))
        .join(bounded(index, n_words), ["stride", "x"])
        .where((F.size("b") >= F.col("needed")) & (F.col("j") <= F.size("b") - F.col("needed")))
        .groupBy(*block, "template", "label")
        .agg(F.count("*").alias("met"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("needed").alias("needed"), F.first("b").alias("b"), F.first("t").alias("t"))
        .where(F.col("met") + F.least(F.size("t") - F.col("i"), F.size("b") - F.col("j")) - 1 >= F.col("needed"))
        .withColumn("shared", F.array_sort(F.transform(F.array_intersect("b", "t"), lambda x: x["token"])))
        .where(F.size("shared") >= F.col("needed"))
        .withColumn("containment", F.size("shared") / F.size("t"))
    )
    # at most one entry a template
    together = paired.groupBy(*block).agg(F.collect_list(F.struct("label", "shared", "containment")).alias("m"))
    beats = lambda o, m: (F.size(F.array_except(m["shared"], o["shared"])) == 0) & ((F.size(o["shared"]) > F.size(m["shared"])) | (o["containment"] > m["containment"]))
    return together.select(*block, F.inline(F.filter("m", lambda m: ~F.exists("m", lambda o: beats(o, m))))).withColumn("shared", F.size("shared"))


def find(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, label, containment and the block's words (from, to, end exclusive) for every match in documents."""
    ordered = order_templates(docs, default_templates(docs.sparkSession) if templates is None else templates)
    rows = read_texts(docs, ordered)
    found = matches(rows, ordered).join(rows.select("_row", "doc_id", "n_words"), "_row")
    start = F.col("block") * F.col("stride")
    return found.select("doc_id", "label", "containment", start.cast("long").alias("from"), F.least(start + 2 * F.col("stride"), F.col("n_words")).cast("long").alias("to"))


def digest(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per document: word count, base places, labels and the best containment (1 where a base phrase stands)."""
    ordered = order_templates(docs, default_templates(docs.sparkSession) if templates is None else templates)
    rows = read_texts(docs, ordered)
    found = matches(rows, ordered).groupBy("_row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    labels = F.array_sort(F.array_distinct(F.concat("_base_labels", F.coalesce("found", F.array().cast("array<string>")))))
    return rows.drop("blocks").join(found, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """Every block of every text against every template, by counting."""
    lower = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = f"regexp_extract_all({lower}, '{WORD}')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEMPLATES)
    phrases = ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, p.split()))}])" for p, label in PHRASES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {cut.format("text")} AS w FROM documents),
t AS (
  SELECT row_number() OVER () AS template, label, list_distinct(w) AS s, greatest({LEAST_STRIDE}, CAST(power(2, ceil(log2(len(w)))) AS BIGINT)) AS stride
  FROM (SELECT label, {cut.format("text")} AS w FROM (VALUES {values}) v(label, text))),
tw AS (SELECT template, label, stride, len(s) AS size, ({CONTAINMENT} * len(s) + 99) // 100 AS needed, unnest(s) AS token FROM t),
tokens AS (SELECT r, unnest(w) AS token, unnest(range(len(w))) AS p FROM docs),
met AS (
  SELECT r, template, label, stride, k, list(DISTINCT token) AS shared, count(DISTINCT token) / any_value(size) AS containment
  FROM (SELECT *, unnest([p // stride, p // stride - 1]) AS k FROM tokens JOIN tw USING (token))
  WHERE k >= 0 GROUP BY r, template, label, stride, k HAVING count(DISTINCT token) >= any_value(needed)),
found AS (
  SELECT r, label, containment FROM met m
  WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.r = m.r AND o.stride = m.stride AND o.k = m.k AND list_has_all(o.shared, m.shared)
                    AND (len(o.shared) > len(m.shared) OR o.containment > m.containment))),
best AS (SELECT r, max(containment) AS best FROM found GROUP BY r),
phrases AS (SELECT * FROM (VALUES {phrases}) v(label, words)),
places AS (SELECT r, p, label FROM tokens JOIN docs USING (r) JOIN phrases ON token = words[1] AND w[p + 1 : p + len(words)] = words),
b AS (SELECT r, count(*) AS n, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION ALL SELECT r, label FROM places) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(a.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.best, 0)::DOUBLE END AS score
FROM docs LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN best USING (r)"""


SQL = _sql()
