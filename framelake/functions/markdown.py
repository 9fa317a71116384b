"""Markdown blocks: what each line is, and which lines are one block, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_kind(line: Column) -> Column:
    """heading, rule, quote, bullets, numbers, table, blank or paragraph."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.rlike("^#{1,6} "), "heading").when(t == "---", "rule").when(t.startswith(">"), "quote")
        .when(t.rlike("^[-*] "), "bullets").when(t.rlike(r"^[0-9]+\. "), "numbers").when(t.startswith("|"), "table").otherwise("paragraph")
    )


def line_text(line: Column, kind: Column) -> Column:
    """The line without its mark."""
    t = F.trim(line)
    return (
        F.when(kind == "heading", F.trim(F.regexp_replace(t, "^#{1,6} +", ""))).when(kind == "quote", F.trim(F.regexp_replace(t, "^>", "")))
        .when(kind == "bullets", F.trim(F.regexp_replace(t, "^[-*] +", ""))).when(kind == "numbers", F.trim(F.regexp_replace(t, r"^[0-9]+\. +", ""))).when(kind == "rule", "").otherwise(t)
    )


def lines(df: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """(doc, pos, kind, level, text) of each line, as the table function md_blocks takes them."""
    kind = line_kind(F.col(line))
    level = F.when(kind == "heading", F.length(F.regexp_extract(F.trim(F.col(line)), "^(#{1,6}) ", 1))).otherwise(0)
    return df.select(F.col(doc).cast("long").alias("doc"), F.col(pos).alias("pos"), kind.alias("kind"), level.cast("int").alias("level"), line_text(F.col(line), kind).alias("text"))


def blocks(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """(doc, block, kind, level, text, n_lines): runs of one kind are a block; headings and rules stand alone.

    Runs are gaps and islands over each document's lines.
    """
    kind = line_kind(F.col(line))
    df = lines.select(doc, pos, line).withColumn("kind", kind)
    w = Window.partitionBy(doc).orderBy(pos)
    new = (F.col("kind") != F.lag("kind", 1, "").over(w)) | F.col("kind").isin("heading", "rule")
    df = df.withColumn("block", F.sum(new.cast("int")).over(w)).where("kind != 'blank'")
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(F.trim(F.col(line)), "^(#{1,6}) ", 1))).otherwise(0)
    part = F.struct(F.col(pos).alias("p"), line_text(F.col(line), F.col("kind")).alias("t"))
    g = df.groupBy(doc, "block", "kind").agg(F.array_sort(F.collect_list(part)).alias("_p"), F.max(level).cast("int").alias("level"), F.count("*").alias("n_lines"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("block")).cast("long")
    text = F.when(F.col("kind") == "paragraph", F.array_join(F.transform("_p", lambda x: x["t"]), " ")).otherwise(F.array_join(F.transform("_p", lambda x: x["t"]), "\n"))
    return g.select(doc, number.alias("block"), "kind", "level", text.alias("text"), "n_lines")
