"""What the operators share: whole-text batches, shared tables, code shipping."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handled as Python objects at once inside a task.
ROWS_AT_ONCE = 256
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    A local master shares the driver's disk, so a temporary folder will do where none is set;
    on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: A key with over one part in so many of all rows is hot, so fewer keys than this are.
HOT_PARTS = 10_000
#: Folders written by stored() and not deleted yet; and those of each open scratch() of this thread.
_STORED: set[str] = set()
_SCOPES: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder (in folders by a column) and read again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    to = df.write.option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for names in (_STORED, *_SCOPES.get()):
        names.add(path)
    return out


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders that stored() wrote; without paths all of them, once results are written."""
    for path in paths or tuple(_STORED):
        if path in _STORED:
            _STORED.discard(path)
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_one(rows: DataFrame, one: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with one(key, ...), which has one row a key, so that no task gets all rows of a hot key.

    Hot keys, of which there are fewer than HOT_PARTS in tables of any size, meet their row
    by broadcast; all others by shuffle. Null keys join nothing. counts(key, n) says how
    often each key comes, where that is known already. Both tables should be stored ones.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col(key).isNotNull() & (F.col("n") * HOT_PARTS > total)).select(key).toArrow()
    if not found.num_rows:
        return rows.join(one, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found))
    often = rows.join(F.broadcast(one.join(hot, key)), key)
    return often.unionByName(rows.join(hot, key, "left_anti").join(one, key))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside, in this thread, is deleted at the end: for work whose result is written by then."""
    mine: set[str] = set()
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        if mine:
            forget(spark, *mine)


def beside(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), where columns of docs named like those it adds are out of its way.

    They come back under their own names; the added ones that clash get leading underscores.
    """
    taken = {c.lower() for c in docs.columns}
    moved = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in added}
    if not moved:
        return work(docs)
    out = work(docs.withColumnsRenamed(moved))
    back = [F.col(moved.get(c, c)).alias(c) for c in docs.columns]
    for c in out.columns[len(docs.columns) :]:
        name = c
        while name.lower() in taken:
            name = "_" + name
        back.append(F.col(c).alias(name))
    return out.select(*back)


def map_rows(
    df: DataFrame, columns: list[str], schema: T.StructType | str, work: Callable[[Iterator[list[tuple]]], Iterable[tuple]]
) -> DataFrame:
    """df's columns as lists of row tuples (strings as UTF-8 bytes), narrow, through Arrow.

    work gets an iterator over lists of at most ROWS_AT_ONCE rows and yields result
    tuples; results leave in batches of that size, so a task never holds its
    partition. Strings come as bytes because the operators' word and line
    rules are rules on ASCII bytes.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.names
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list[tuple]]:
            for b in batches:
                cols = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c.cast(pa.large_binary()) if pa.types.is_large_string(c.type) else c for c in b.columns]
                for k in range(0, b.num_rows, ROWS_AT_ONCE):
                    yield list(zip(*(c.slice(k, ROWS_AT_ONCE).to_pylist() for c in cols)))

        held: list[tuple] = []
        for out in work(rows()):
            held.append(out)
            if len(held) >= 1024:
                yield _batch(held, names, target)
                held = []
        if held:
            yield _batch(held, names, target)

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=target.field(n).type) for n, c in zip(names, zip(*rows))], schema=target)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def each_row(work: Callable[..., tuple]) -> Callable[[Iterator[list[tuple]]], Iterator[tuple]]:
    """work on one row's values, lifted to what map_rows takes."""

    def run(chunks: Iterator[list[tuple]]) -> Iterator[tuple]:
        for chunk in chunks:
            for row in chunk:
                yield work(*row)

    return run


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def held_out() -> Column:
    """Rows that nothing may be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
