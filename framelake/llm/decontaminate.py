"""Benchmark decontamination with Wu-Manber multi-pattern search over word sequences.

Patterns are windows of 13 item words; an item of fewer words is one window of its own
length. For each window length, blocks of two words have a shift: how far the search
may jump without passing an occurrence. Shifts lie in a table of bytes indexed by a hash
of the block, where the least of those that meet stands. A block of shift 0 may end a window: the
hash of this suffix picks a bucket of windows, in which that of the first block selects
those that direct comparison then confirms.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text; every block is searched
over all documents and the hits of the blocks are united. A block's tables are arrays
of about 25 bytes a word and the text itself, so what is broadcast stays bounded
however many items there are.

Defined cases: null or wordless texts have no words and are never contaminated;
wordless items have no windows; repeated item_ids count once; repeated documents are
all returned; a null item_id is named by the empty string; columns of docs that are
named like those added stay as they are and the added ones get a leading underscore.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, each_row, map_rows

WINDOW = 13
BLOCK_BYTES = 8_000_000
#: A document is contaminated if hit words times this reach its words.
SHARE = 20
#: Lower-cased bytes of words; everything else separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WuManber:
    """Search for windows of words; windows of one length share one shift table."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        by_length: dict[int, list[tuple[str, list[bytes]]]] = defaultdict(list)
        for item, text in items:
            if words := words_of(text):
                by_length[min(window, len(words))].append((item, words))
        self.tables = [_Windows(m, held) for m, held in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit stretches [start, end) of words, not united, and the items found."""
        found, items = [], set()
        for t in self.tables:
            t.find(words, found, items)
        return found, items


class _Windows:
    """The windows of ``m`` words of some items."""

    def __init__(self, m: int, items: list[tuple[str, list[bytes]]]) -> None:
        self.m, self.size = m, min(2, m)
        self.items = [item for item, _ in items]
        lines = [b" ".join(w) for _, w in items]
        self.text = b" ".join(lines)
        lengths = np.array([len(w) for _, ws in items for w in ws], np.int64)
        #: Where each word ends in the text, and each item's first word.
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.firsts = np.cumsum([0, *(len(w) for _, w in items[:-1])]).tolist()
        cells = 1 << max(10, (2 * len(lengths)).bit_length())
        self.mask = cells - 1
        #: Jumps are at most m - size + 1; a cell holds at most 255.
        self.far = min(255, m - self.size + 1)
        shift = np.full(cells, self.far, np.uint8)
        keys, places = [], []
        for first, (_, words), line in zip(self.firsts, items, lines):
            # The block that ends at word e of an item ends windows from e = m - 1 on.
            for e in range(self.size - 1, len(words)):
                cell = self._block(words, e) & self.mask
                shift[cell] = min(shift[cell], max(0, m - 1 - e))
            base = int(self.starts[first])
            begin, end = (self.starts[first : first + len(words)] - base).tolist(), (self.ends[first : first + len(words)] - base).tolist()
            seen = set()
            for i in range(len(words) - m + 1):
                if (window := line[begin[i] : end[i + m - 1]]) not in seen:  # a window that an item repeats counts once
                    seen.add(window)
                    keys.append(self._key(words, i + m))
                    places.append(first + i)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.shift = shift.tobytes()
        #: Buckets in order: windows by the hash of their suffix, within it by that of their first block.
        self.hashes, self.places = np.array(keys, np.uint64)[order], np.array(places, np.int32)[order]

    def _block(self, words: list[bytes], e: int) -> int:
        return zlib.crc32(words[e] if self.size == 1 else words[e - 1] + b" " + words[e])

    def _key(self, words: list[bytes], end: int) -> int:
        """Bucket and selector of the window that ends before a word."""
        return self._block(words, end - 1) << 32 | self._block(words, end - self.m + self.size - 1)

    def find(self, words: list[bytes], found: list[tuple[int, int]], items: set) -> None:
        m, pair, far, mask, shift, crc = self.m, self.size == 2, self.far, self.mask, self.shift, zlib.crc32
        i, n = m, len(words)
        while i <= n:
            step = shift[crc(words[i - 2] + b" " + words[i - 1] if pair else words[i - 1]) & mask]
            if step:
                i += step
                continue
            if who := self._owners(words, i):
                found.append((i - m, i))
                items.update(who)
            i += 1

    def _owners(self, words: list[bytes], end: int) -> set:
        key = np.uint64(self._key(words, end))
        k, out, line = int(self.hashes.searchsorted(key)), set(), None
        while k < len(self.hashes) and self.hashes[k] == key:
            line = line or b" ".join(words[end - self.m : end])
            at = int(self.places[k])
            if self.text[self.starts[at] : self.ends[at + self.m - 1]] == line:
                out.add(self.items[bisect_right(self.firsts, at) - 1])
            k += 1
        return out


def united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """(item, text) by blocks of about BLOCK_BYTES of text, dealt by a hash."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    if n > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        return [items.where(F.col("block") == k).drop("block") for k in range(n)]
    return [items]


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, hits array<struct<start,end>> and items array<string> added.

    One narrow pass for each block of items; a pass adds to what the passes before
    it found in the row.
    """
    return beside(docs, ("n_words", "hits", "items"), lambda d: _search(d, benchmark, window))


def _search(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    from pyspark.sql import types as T

    out = docs
    hits_type = "array<struct<start:int,end:int>>"
    for k, block in enumerate(_blocks(benchmark)):
        tables = docs.sparkSession.sparkContext.broadcast(WuManber([(r["item"], r["text"].encode()) for r in block.collect()], window))
        keep = out.columns[: len(docs.columns)]
        fields = out.select(*keep).schema.fields
        strings = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
        schema = T.StructType([*fields, *T.StructType.fromDDL(f"n_words long, hits {hits_type}, items array<string>").fields])
        if k == 0:
            out = out.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(hits_type), "items": F.array().cast("array<string>")})
        at = keep.index("text")

        def one(*row, at=at, strings=strings, tables=tables):
            values, (_, hits, items) = list(row[:-3]), row[-3:]
            words = words_of(values[at])
            found, who = tables.value.find(words)
            for i in strings:
                values[i] = None if values[i] is None else values[i].decode()
            hits = united([*((x["start"], x["end"]) for x in hits), *found])
            return *values, len(words), [{"start": a, "end": b} for a, b in hits], sorted({*items, *who})

        out = map_rows(out, [*keep, "n_words", "hits", "items"], schema, each_row(one))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs with n_words, items, n_hit and contaminated added."""

    def work(d: DataFrame) -> DataFrame:
        n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
        out = _search(d, benchmark, window).withColumn("n_hit", n_hit).drop("hits")
        return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))

    return beside(docs, ("n_words", "hits", "items", "n_hit", "contaminated"), work)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    out = contamination(docs, benchmark, window, share)
    return out.where(~F.col(out.columns[-1])).select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(13, len(w)) AS m,
         array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win))
), hit AS (
  SELECT r, i, pos.m, item FROM pos JOIN win ON pos.k = win.k AND pos.m = win.m
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
