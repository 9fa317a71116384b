"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits have a midpoint within 2 bits of both, so every distinct
fingerprint emits the 2,081 values within 2 bits of itself and links to whatever emits
the same value; by the triangle inequality such a collision is a link, and the pair is
verified again before it counts. Three things keep this small:

* exact copies are one fingerprint before anything is emitted;
* values are shuffled by a route, the parities of ``groups`` interleaved sets of bits.
  A ball reaches only 1 + g + g(g-1)/2 routes, so what crosses the network is one 8-byte
  fingerprint for each route, packed, and the task of the route spells out the values
  of its own. A hot group of near copies spreads over all its routes;
* a task emits a spanning forest of the links it found, not the pairs of a bucket.

Fingerprints that hold a large share of all rows get their component by broadcast of
those few fingerprints, so their rows stay where they are.

Components are then found over distinct fingerprints by label propagation with pointer
jumping, each round written to the shared folder.

Defined cases: null, empty or wordless texts have fingerprint zero and link like any
other; fewer than 4 words are one shingle; a null doc_id is a row of its own that gets
its group's component_id but is never the id of one, unless all ids are null (then
null). Repeated rows are all returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, forget, join_one, map_rows, stored

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints a route should get, about; more fingerprints mean more routes.
ROUTE_SIZE = 40_000
#: Ball values spelled out at once inside a task.
VALUES_AT_ONCE = 4_000_000


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = (text or b"").translate(LOWER).split()
    n = len(words) - size + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        hashes, n = [xxhash.xxh64_intdigest(line, SEED)], 1
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    counts = np.zeros(BITS, np.int64)
    h = np.array(hashes, np.uint64)
    for k in range(0, n, 65_536):
        part = h[k : k + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of every row; h is a hash of the text."""

    def run(chunks):
        for chunk in chunks:
            for doc_id, h, text in chunk:
                fp = fingerprint(text)
                yield doc_id, h, fp - (1 << 64) if fp >> 63 else fp

    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return map_rows(hashed, ["doc_id", "h", "text"], "doc_id long, h long, fp long", run)


class Ball:
    """Values within ``radius`` bits, by how their route differs from the centre's."""

    def __init__(self, groups: int, radius: int = RADIUS // 2) -> None:
        self.groups = groups
        masks = defaultdict(list)
        for k in range(radius + 1):
            for bits in combinations(range(BITS), k):
                route = 0
                for b in bits:
                    route ^= 1 << b % groups
                masks[route].append(sum(1 << b for b in bits))
        self.masks = {r: np.array(m, np.uint64) for r, m in masks.items()}
        self.sets = [np.uint64(sum(1 << b for b in range(BITS) if b % groups == g)) for g in range(groups)]

    def route(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for g, s in enumerate(self.sets):
            out |= (np.bitwise_count(fps & s).astype(np.int64) & 1) << g
        return out

    def forest(self, fps: np.ndarray, route: int) -> list[tuple[int, int]]:
        """A spanning forest of the links whose shared value lies on this route."""
        fps = np.unique(fps)
        if len(fps) < 2:
            return []
        away = self.route(fps) ^ route
        kinds = [(np.flatnonzero(away == d), self.masks[d]) for d in np.unique(away).tolist()]
        total = sum(len(i) * len(m) for i, m in kinds)
        passes = max(1, -(-total // VALUES_AT_ONCE))
        root = np.arange(len(fps))
        for p in range(passes):
            values, who = [], []
            for i, m in kinds:
                step = max(1, VALUES_AT_ONCE // len(m))
                for k in range(0, len(i), step):
                    v = (fps[i[k : k + step], None] ^ m[None, :]).ravel()
                    w = np.repeat(i[k : k + step], len(m))
                    if passes > 1:
                        mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == p
                        v, w = v[mine], w[mine]
                    values.append(v)
                    who.append(w)
            v, w = np.concatenate(values), np.concatenate(who)
            order = np.argsort(v)
            v, w = v[order], w[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            a, b = w[same], w[same + 1]
            verified = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
            root = _joined(root, a[verified], b[verified])
        return [(int(fps[i]), int(fps[r])) for i, r in enumerate(root.tolist()) if i != r]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the links a-b: each member points at the least of its component."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def _groups_for(n: int) -> int:
    g = 8
    while g < 24 and n * (1 + g + g * (g - 1) // 2) / 2**g > ROUTE_SIZE:
        g += 1
    return g


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b as unsigned order of discovery: a forest on the linked fingerprints of fps(fp)."""
    ball = Ball(_groups_for(fps.count()))
    reach = np.array(sorted(ball.masks), np.int64)

    def send(batches):
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        n = 0
        target = pa.schema([("route", pa.int64()), ("fps", pa.binary())])

        def flush():
            rows = [(r, np.concatenate(v).tobytes()) for r, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=target)

        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                f = b.column(0).slice(k, 20_000).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                routes = (ball.route(f)[:, None] ^ reach[None, :]).ravel()
                order = np.argsort(routes, kind="stable")
                cut = np.flatnonzero(np.diff(routes[order])) + 1
                sent = np.repeat(f, len(reach))[order]
                for part, first in zip(np.split(sent, cut), np.concatenate([[0], cut])):
                    held[int(routes[order[first]])].append(part)
                n += len(sent)
                if n > VALUES_AT_ONCE:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        f = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("fps").to_pylist()])
        found = np.array(ball.forest(f, table.column("route")[0].as_py()), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    sent = fps.select("fp").mapInArrow(send, "route long, fps binary")
    return sent.groupBy("route").applyInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of edges(a, b), by rounds of label propagation.

    A round takes the least label next to each node and then follows labels to their
    own labels, so long chains halve. Aggregates are partial before each shuffle, and a
    node with very many links, or a label of very many nodes, is met by broadcast.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "simhash-edges")
    degrees = stored(both.groupBy("b").agg(F.count("*").alias("n")), "simhash-degrees")
    found = labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")), "simhash-labels")
    while True:
        near = join_one(both, labels.withColumnRenamed("fp", "b"), "b", degrees).groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        best = stored(labels.join(near, "fp").select("fp", F.least("root", "near").alias("best"), "root"), "simhash-best")
        jump = labels.select(F.col("fp").alias("best"), F.col("root").alias("jump"))
        new = join_one(best, jump, "best").select("fp", F.least("best", "jump").alias("root"), (F.least("best", "jump") != F.col("root")).alias("moved"))
        new = stored(new, "simhash-labels")
        forget(new.sparkSession, found.stored_at, best.stored_at)  # the round before is read no more
        found, labels = new, new.select("fp", "root")
        if not new.where("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for every row of docs; root names the component even without ids."""
    rows = stored(fingerprints(docs), "simhash-fps")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "simhash-distinct")
    labels = components(stored(links(distinct), "simhash-links"))
    # The fingerprints that have links are a small part; the others are their own class.
    rooted = stored(distinct.join(labels, "fp"), "simhash-rooted")
    ids = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = join_one(rooted, ids, "root").select("fp", "root", "component_id")
    alone = distinct.join(labels, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first_doc").alias("component_id"))
    classes = stored(linked.unionByName(alone), "simhash-classes")
    return join_one(rows, classes, "fp", distinct.select("fp", "n")).select("doc_id", "h", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: the smallest doc_id's, a null id's only if all are null.

    Of rows that share that id the one with the least text hash stays, and one of rows
    whose id and text are equal. Only rows that repeat are deduplicated by text.
    """
    found = stored(near_duplicates(docs).select("doc_id", "h", "root"), "simhash-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    best = found.groupBy("root").agg(first).select("first.doc_id", "first.h")
    repeated = stored(found.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"), "simhash-repeated")

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(rows["text"]) == keys["h"]), how)

    kept = among(docs, best, "left_semi")
    if not repeated.limit(1).count():
        return kept
    once = among(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return among(kept, repeated, "left_anti").unionByName(once)


def digest(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
