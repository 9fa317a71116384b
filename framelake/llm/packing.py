"""Packing into sequences of 2048 tokens: first-fit decreasing in randomised groups.

A document's ids (and the end id) are cut every 2048. Each piece is dealt to a group by a
hash of its content and its place in the input, so neither the pieces of a long document
nor rows that repeat meet in one group. Each group is packed on its own by first-fit
decreasing, where a tournament tree over the capacities of the bins finds the first bin
that fits in O(log bins).

Pieces travel as descriptions, never as ids, and are written before they are dealt: a
task that is run again can't deal them otherwise. ``sequences`` builds the padded ids.

Defined cases: null or empty text is the end id alone; a null doc_id is packed like any
other; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

LENGTH, END_ID = 2048, 1
#: Pieces in a group, about. A group is one task's work and its bins are in memory.
GROUP_PIECES = 16_384


class Encoder:
    """Ids of public_tokenizers' byte_bpe_50k by tiktoken, which has the same vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        self.tiktoken = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        return self.tiktoken.encode_to_numpy(text, allowed_special="all")


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One per Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut(docs: DataFrame, name: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, place): pieces of every document; place counts the pieces of a task."""

    def run(chunks):
        enc, place = encoder(name), 0
        for chunk in chunks:
            for doc_id, text in chunk:
                ids = np.append(enc.ids((text or b"").decode()), np.uint32(END_ID)).astype("<u4")
                for k in range(0, len(ids), length):
                    piece = ids[k : k + length]
                    yield doc_id, k, len(piece), zlib.crc32(piece.tobytes()), len(ids), place
                    place += 1

    return map_rows(docs, ["doc_id", "text"], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long", run)


class Bins:
    """Bins opened so far under a tournament tree: a node holds the larger capacity of its two."""

    def __init__(self, most: int, length: int) -> None:
        self.leaves = 1
        while self.leaves < most:
            self.leaves *= 2
        self.tree = [length] * (2 * self.leaves)

    def first_fit(self, need: int) -> tuple[int, int]:
        """Puts need into the first bin that has room; its number and room before."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        room = tree[k]
        tree[k] = room - need
        number = k - self.leaves
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return number, room


def first_fit_decreasing(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; ties keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Bins(max(1, len(lengths)), length)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], room = tree.first_fit(int(lengths[i]))
        offsets[i] = length - room
    return bins, offsets


def pack(docs: DataFrame, name: str = "byte_bpe_50k", length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset. The group is the upper part of sequence_id."""
    pieces = stored(cut(docs, name, length), "packing-pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(np.int64), length)
        return pdf.drop(columns=["grp", "place"]).assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("grp").applyInPandas(one, columns)


def sequences(docs: DataFrame, pieces: DataFrame, name: str = "byte_bpe_50k", length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed ids, padded to length unless at a power of two.

    Documents meet their pieces by doc_id, which must not repeat here.
    """
    plan = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("plan"))

    def run(chunks):
        enc = encoder(name)
        for chunk in chunks:
            for text, plan_ in chunk:
                ids = [*enc.ids((text or b"").decode()).tolist(), END_ID]
                for p in plan_:
                    yield p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]]

    parts = map_rows(docs.join(plan, "doc_id"), ["text", "plan"], "sequence_id long, offset long, ids array<int>", run)
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda x: x["ids"]))
    n = F.size("ids")
    padded = F.when(F.expr("bit_count(size(ids)) = 1"), F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - n)))
    return joined.select("sequence_id", ids.alias("ids")).select("sequence_id", padded.alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
