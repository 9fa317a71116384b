"""Line dedup that can be undone: exact reference-count tables behind sharded cuckoo filters.

An index is kept in the shared folder as three tables:

* references, a log: each insertion appends its (line key, document) rows, each deletion
  the ids it takes away; a reference lives unless its document was deleted later. From the
  first change on they are laid out twice, in folders by shard of the key and in folders by
  bucket of the document;
* counts, one row a line key with its number of documents and the largest one, in shards
  by key;
* a cuckoo filter for each shard, over the keys whose lines are dropped now.

Inserting documents reads the references in their buckets, to tell new ones from known
ones; deleting documents reads those in their buckets, and those in the shards of the keys
they held, to see who keeps a line now. Neither reads other folders. A log of more than
MAX_LOG changes is written anew as one. Inserting or deleting documents rewrites only the
shards of their keys: counts of those keys change, and keys that come to be dropped or stop being so are added to or removed from their
shard's filter one by one. A filter only says where to look, the counts decide. Every
change gives a new index and leaves the old one as it was.

A key is a 128-bit hash of the stripped, A-Z-lowered line; only keys of at least
``min_chars`` code points count. Keys found in at least ``min_docs`` documents lose
their lines except in the largest doc_id that holds them.

Defined cases: null text is one empty line. A null doc_id counts towards no document
and so never keeps a dropped key. Repeated rows of one doc_id count once and are all
returned. An empty table gives no rows. Other columns pass through untouched; where
one is named like an added column, the added one gets a leading underscore.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, beside, each_row, map_rows, stored

MIN_CHARS, MIN_DOCS = 40, 5
#: Dropped keys (24 bytes each) that may be broadcast; beyond it lines are joined.
MAX_BROADCAST_KEYS = 1_000_000
#: Keys in a shard, about, and the most shards (they are folders; beyond it shards grow).
SHARD_KEYS, MAX_SHARDS = 500_000, 4096
#: Changes after which the references are laid out anew.
MAX_LOG = 16
#: Keys that ask one filter in one task, about.
ASKED_KEYS = 1_000_000
#: Documents from which on a dropped key is hot; of n references at most n / HOT_DOCS are.
HOT_DOCS = 100_000
#: Ids or hot keys that may be broadcast.
MAX_BROADCAST_ROWS = 4_000_000


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    k = line.strip().translate(LOWER)
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode()) < min_chars:
        return None
    d = xxhash.xxh3_128_digest(k)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


class CuckooFilter:
    """Cuckoo filter of 64-bit keys: 4 slots a bucket, 16-bit marks, with removal.

    Keys that find no slot after ``KICKS`` moves go to ``rest``, so an insertion never
    fails and a removal never removes another key's last mark.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int) -> None:
        n = 1
        while n * self.SLOTS * 0.9 < max(1, capacity):
            n *= 2
        self.mask, self.table, self.rest = n - 1, np.zeros((n, self.SLOTS), np.uint16), []

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = int(self._mark(np.array([key], np.int64))[0])
        at = key & self.mask
        return mark, at, at ^ ((mark * 0x5BD1E995) & self.mask)

    def add(self, key: int) -> None:
        mark, at, other = self._places(key)
        for b in (at, other):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return
        for k in range(self.KICKS):
            slot = k % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= (mark * 0x5BD1E995) & self.mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        self.rest.append((mark, at))

    def remove(self, key: int) -> bool:
        mark, at, other = self._places(key)
        for b in (at, other):
            held = np.flatnonzero(self.table[b] == mark)
            if len(held):
                self.table[b, held[0]] = 0
                return True
        for b in (at, other):
            if (mark, b) in self.rest:
                self.rest.remove((mark, b))
                return True
        return False

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        marks = self._mark(keys)
        at = keys.astype(np.int64) & self.mask
        other = at ^ ((marks.astype(np.int64) * 0x5BD1E995) & self.mask)
        out = (self.table[at] == marks[:, None]).any(1) | (self.table[other] == marks[:, None]).any(1)
        if self.rest:
            rest = set(self.rest)
            out |= np.fromiter(((int(m), int(b)) in rest or (int(m), int(o)) in rest for m, b, o in zip(marks, at, other)), bool, len(keys))
        return out

    def to_bytes(self) -> bytes:
        rest = np.array(self.rest or np.zeros((0, 2)), np.int64)
        return np.int64([self.mask + 1, len(rest)]).tobytes() + self.table.tobytes() + rest.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, m = (int(x) for x in np.frombuffer(data[:16], np.int64))
        self = cls.__new__(cls)
        self.mask, end = n - 1, 16 + n * cls.SLOTS * 2
        self.table = np.frombuffer(data[16:end], np.uint16).reshape(n, cls.SLOTS).copy()
        self.rest = [tuple(x) for x in np.frombuffer(data[end:], np.int64).reshape(m, 2).tolist()]
        return self


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id) for each distinct key of each document."""

    def run(chunks):
        for chunk in chunks:
            for doc_id, text in chunk:
                if doc_id is not None and text:
                    for k in {key_of(x, min_chars) for x in text.split(b"\n")} - {None}:
                        yield *k, doc_id

    return map_rows(docs, ["doc_id", "text"], "h1 long, h2 long, doc_id long", run)


def _sized(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _built(keys: list[int], room: float = 1.5) -> CuckooFilter:
    f = CuckooFilter(int(len(keys) * room))
    for k in keys:
        f.add(k)
    return f


def _update(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its changes: left is the old filter, right its keys as (shard, h1, change)."""
    old = CuckooFilter.from_bytes(left["filter"].iloc[0]) if len(left) else None
    kept = right["change"].to_numpy() >= 0
    if old is None or kept.sum() > old.table.size * 0.9:
        old = _built(right["h1"][kept].tolist())
    else:
        for h, by in zip(right["h1"].tolist(), right["change"].tolist()):
            if by > 0:
                old.add(h)
            elif by < 0:
                old.remove(h)
    return pd.DataFrame({"shard": [right["shard"].iloc[0]], "filter": [old.to_bytes()], "n_keys": [int(kept.sum())]})


_FILTER = "shard int, filter binary, n_keys long"


class LineIndex:
    """References, counts and filters in stored tables; every change gives a new index.

    ``at`` says for each shard in which of ``counts`` and ``filters`` (one table a change)
    its rows are now; ``log`` lists references added, as tables by name ("all", or "shard" and
    "bucket"), and ids deleted ("gone"), in order.
    """

    def __init__(self, log: list[dict[str, DataFrame]], counts: list[DataFrame], filters: list[DataFrame], at: dict[int, int], shards: int, min_chars: int, min_docs: int) -> None:
        self.log, self._counts, self._filters, self.at, self.shards, self.min_chars, self.min_docs = log, counts, filters, at, shards, min_chars, min_docs
        #: Shards that the change which made this index rewrote.
        self.touched = sorted(s for s, k in at.items() if k == len(counts) - 1)
        self.n_dropped = self.filters.agg(F.sum("n_keys")).first()[0] or 0

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        refs = stored(references(docs, min_chars).distinct(), "line-refs")
        counts = _counted(refs)
        shards = min(MAX_SHARDS, max(1, -(-refs.count() // SHARD_KEYS)))
        counts = _by_shard(counts.withColumn("shard", _shard(shards)))
        filters = stored(_changes(counts.withColumn("before", F.lit(0)), min_docs).groupBy("shard").applyInPandas(lambda keys: _update(keys[:0], keys), _FILTER), "line-filters")
        return cls([{"all": refs}], [counts], [filters], dict.fromkeys(range(shards), 0), shards, min_chars, min_docs)

    def _current(self, tables: list[DataFrame], only: list[int] | None = None) -> DataFrame:
        """The rows of shards (of only these), each from the table that has them now; folders of others aren't read."""
        out, wanted = None, set(self.at if only is None else only)
        for k, t in enumerate(tables):
            mine = [s for s, g in self.at.items() if g == k and s in wanted]
            if mine:
                part = t if len(mine) == self.shards else t.where(F.col("shard").isin(mine))
                out = part if out is None else out.unionByName(part)
        return tables[0].limit(0) if out is None else out

    @property
    def counts(self) -> DataFrame:
        return self._current(self._counts)

    @property
    def filters(self) -> DataFrame:
        return self._current(self._filters)

    @property
    def dropped(self) -> DataFrame:
        """Keys whose lines go now, with the document that keeps its lines."""
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    @property
    def refs(self) -> DataFrame:
        """The living references: those whose document no later deletion took."""
        return self._living("shard", None)

    def _living(self, name: str, only: list[int] | None) -> DataFrame:
        """The living references of these shards or buckets; folders of others aren't read."""
        out = None
        for entry in self.log:
            if "gone" in entry:
                out = out.join(_sized(entry["gone"]), "doc_id", "left_anti")
            else:
                t = entry["all"] if "all" in entry else entry[name] if only is None else entry[name].where(F.col(name).isin(only))
                t = t.select("h1", "h2", "doc_id")
                out = t if out is None else out.unionByName(t)
        return out.select("h1", "h2", "doc_id")

    def _lay_out(self) -> None:
        """References by shard and by bucket: those of the beginning at the first change, all of them when the log is long."""
        if len(self.log) > MAX_LOG:
            self.log = [self._laid(self.refs)]
        self.log = [self._laid(e["all"]) if "all" in e else e for e in self.log]

    def _laid(self, refs: DataFrame) -> dict[str, DataFrame]:
        rows = refs.select("h1", "h2", "doc_id", _shard(self.shards).alias("shard"), _bucket(self.shards).alias("bucket"))
        return {by: stored(rows.select("h1", "h2", "doc_id", by).repartition(by), f"line-refs-{by}", by=by) for by in ("shard", "bucket")}

    def insert(self, docs: DataFrame) -> LineIndex:
        self._lay_out()
        found = stored(references(docs, self.min_chars).distinct(), "line-found")
        known = self._living("bucket", _distinct(found.select(_bucket(self.shards).alias("n"))))
        new = stored(found.join(known, ["h1", "h2", "doc_id"], "left_anti"), "line-refs")
        return self._changed(self._laid(new), _counted(new).withColumn("by", F.col("n_docs")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents in doc_ids(doc_id): as if they had never come."""
        self._lay_out()
        gone = stored(doc_ids.where("doc_id is not null").select("doc_id").distinct(), "line-deleted")
        theirs = self._living("bucket", _distinct(gone.select(_bucket(self.shards).alias("n"))))
        lost = stored(theirs.join(_sized(gone), "doc_id", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("lost")), "line-lost")
        left = self._living("shard", _distinct(lost.select(_shard(self.shards).alias("n"))))
        left = left.join(_sized(gone), "doc_id", "left_anti").join(_sized(lost), ["h1", "h2"], "left_semi")
        keep = left.groupBy("h1", "h2").agg(F.max("doc_id").alias("keep_doc"))
        return self._changed({"gone": gone}, lost.join(keep, ["h1", "h2"], "left").select("h1", "h2", "keep_doc", (-F.col("lost")).alias("by")))

    def _changed(self, entry: dict[str, DataFrame], delta: DataFrame) -> LineIndex:
        """After delta(h1, h2, by, keep_doc): only its shards are read and written again."""
        delta = stored(delta.select("h1", "h2", "by", F.col("keep_doc").alias("_keep"), _shard(self.shards).alias("shard")), "line-delta")
        touched = [r["shard"] for r in delta.select("shard").distinct().collect()]
        old = self._current(self._counts, touched)
        both = old.join(delta, ["shard", "h1", "h2"], "full")
        now = F.coalesce("n_docs", F.lit(0)) + F.coalesce("by", F.lit(0))
        keep = F.when(F.col("by") < 0, F.col("_keep")).otherwise(F.greatest("keep_doc", "_keep"))
        both = _by_shard(both.select("h1", "h2", now.alias("n_docs"), keep.alias("keep_doc"), F.coalesce("n_docs", F.lit(0)).alias("before"), "shard"))
        filters = self._current(self._filters, touched).groupBy("shard").cogroup(_changes(both, self.min_docs).groupBy("shard")).applyInPandas(lambda a, b: _update(a, b) if len(b) else a, _FILTER)
        at = self.at | dict.fromkeys(touched, len(self._counts))
        counts = both.where("n_docs > 0").drop("before")
        return LineIndex([*self.log, entry], [*self._counts, counts], [*self._filters, stored(filters, "line-filters")], at, self.shards, self.min_chars, self.min_docs)

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with ``text`` cut, plus n_lines (before) and n_dropped; all else kept."""

        def work(d: DataFrame) -> DataFrame:
            keep = [c for c in d.columns if c != "text"]
            return self._by_broadcast(d, keep) if self.n_dropped <= MAX_BROADCAST_KEYS else self._by_join(d, keep)

        return beside(docs, ("n_lines", "n_dropped", "_gone", "_id"), work)

    def _cutter(self, docs: DataFrame, keep: list[str], extra: list[str], test) -> DataFrame:
        """The narrow pass over whole texts; test(doc_id, keys, extra value) marks lines to drop."""
        schema = docs.select(*keep).schema
        fields = [*schema.fields]
        from pyspark.sql import types as T

        out = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        strings = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
        at, min_chars = keep.index("doc_id"), self.min_chars

        def one(*row):
            values, text, more = list(row[: len(keep)]), row[len(keep)] or b"", row[len(keep) + 1 :]
            for i in strings:
                values[i] = None if values[i] is None else values[i].decode()
            lines = text.split(b"\n")
            keys = [key_of(x, min_chars) for x in lines]
            known = [k for k in keys if k]
            gone = test(values[at], known, *more) if known else frozenset()
            left = [x for x, k in zip(lines, keys) if k not in gone] if gone else lines
            return *values, b"\n".join(left).decode(), len(lines), len(lines) - len(left)

        return map_rows(docs, [*keep, "text", *extra], out, each_row(one)).select(*[c for c in docs.columns if c not in extra], "n_lines", "n_dropped")

    def _by_broadcast(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        sc = docs.sparkSession.sparkContext
        filters = self.filters.where("n_keys > 0").toPandas()
        rows = self.dropped.select("h1", "h2", "keep_doc").toPandas()
        rows = rows.sort_values("h1", kind="stable")
        table = sc.broadcast((dict(zip(filters["shard"].tolist(), filters["filter"].tolist())), self.shards, *(rows[c].to_numpy(np.int64) for c in ("h1", "h2", "keep_doc"))))
        held: dict = {}

        def test(doc_id, keys):
            raw, n, h1, h2, keep_doc = table.value
            if "filters" not in held:
                held["filters"] = {k: CuckooFilter.from_bytes(v) for k, v in raw.items()}
            gone = set()
            a = np.array(keys, np.int64)
            shards = a[:, 1] % n
            for s in np.unique(shards).tolist():
                if (f := held["filters"].get(s)) is None:
                    continue
                some = np.flatnonzero(shards == s)
                for i in some[f.may_hold(a[some, 0])].tolist():
                    for j in range(np.searchsorted(h1, a[i, 0]), np.searchsorted(h1, a[i, 0], "right")):
                        if h2[j] == a[i, 1] and keep_doc[j] != doc_id:
                            gone.add(keys[i])
            return gone

        return self._cutter(docs, keep, [], test)

    def asked(self, keys: DataFrame, n_keys: int) -> DataFrame:
        """Those of the distinct keys(h1, h2) that their shard's filter may hold; a group is a slice of a shard's keys beside its filter."""
        slices = max(1, -(-n_keys // (self.shards * ASKED_KEYS)))
        part = F.pmod("h1", F.lit(slices)).cast("int").alias("part")

        def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            keys_, filters = left[["h1", "h2"]], right["filter"]
            return keys_[CuckooFilter.from_bytes(filters.iloc[0]).may_hold(keys_["h1"].to_numpy(np.int64))] if len(keys_) and len(filters) else keys_[:0]

        split = keys.select("h1", "h2", _shard(self.shards).alias("shard"), part)
        filters = self.filters.where("n_keys > 0").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"))
        return split.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(ask, "h1 long, h2 long")

    def _by_join(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """Beyond the broadcast bound: the documents' keys ask the filters, what may be dropped meets the counts, then the documents.

        Hot keys join by broadcast (their number is bounded), so no task gets all documents of one.
        A null doc_id has no references, so its lines are looked up by a hash of its text.
        """
        rows = docs.withColumn("_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id")))

        def cut(part: DataFrame, nameless: bool) -> DataFrame:
            ids = part.select(F.col("_id").alias("doc_id"), "text")
            refs = stored(references(ids, self.min_chars).distinct(), "line-asking")
            keys = stored(refs.select("h1", "h2").distinct(), "line-keys")
            lost = stored(self.asked(keys, keys.count()).join(self.dropped.select("h1", "h2", "keep_doc", "n_docs"), ["h1", "h2"]), "line-lost")
            hot, cold = (_sized(lost.where(f"n_docs >= {HOT_DOCS}")), lost.where(f"n_docs < {HOT_DOCS}"))
            met = refs.join(hot, ["h1", "h2"]).unionByName(refs.join(cold, ["h1", "h2"]))
            met = met if nameless else met.where("doc_id != keep_doc")
            per_doc = met.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("_gone"))
            return self._cutter(part.join(per_doc, "_id", "left").select(*docs.columns, "_gone"), keep, ["_gone"], lambda _, keys_, gone: {(x["h1"], x["h2"]) for x in gone or ()})

        out = cut(rows.where("doc_id is not null"), False)
        nameless = rows.where("doc_id is null")
        return out.unionByName(cut(nameless, True)) if nameless.limit(1).count() else out


def _shard(shards: int) -> Column:
    return F.pmod("h2", F.lit(shards)).cast("int")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _distinct(numbers: DataFrame) -> list[int]:
    """Shard or bucket numbers, of which there are at most MAX_SHARDS."""
    return sorted(r[0] for r in numbers.distinct().collect())


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"))


def _by_shard(counts: DataFrame) -> DataFrame:
    """counts written in a folder for each shard."""
    return stored(counts.repartition("shard"), "line-counts", by="shard")


def _changes(counts: DataFrame, min_docs: int) -> DataFrame:
    """(shard, h1, change) of the keys that are dropped now (1: newly) or were until now (-1)."""
    now, before = F.col("n_docs") >= min_docs, F.col("before") >= min_docs
    return counts.where(now | before).select("shard", "h1", (now.cast("int") - before.cast("int")).alias("change"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return LineIndex.of(docs, min_chars, min_docs).apply(docs)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), hot AS (
  SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keep_doc AS gone
  FROM k LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
