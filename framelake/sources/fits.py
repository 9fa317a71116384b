"""FITS frames as tables: headers, scanlines, and a writer.

Files are listed by Spark's binaryFile source, so any store Spark reads will do; a file is
one row and decoding runs in its task. Headers are read by range, HEAD bytes of each file;
whole files are read for pixels, and for headers only in stores that offer nothing else.
Pixels are one row for each channel and scanline. ``FitsDataSource`` offers the header
table as a format of its own, which takes filters on paths.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from framelake.schema import FRAMES, PIXEL_ROWS
from framelake.sources import store

BLOCK, CARD = 2880, 80
#: Bytes of a file that hold its header, far more than any real one.
HEAD = 256 * 1024
#: Big-endian sample types by BITPIX, and what scaled integers are divided by.
SAMPLES = {8: ("u1", 255.0), 16: (">i2", 65535.0), 32: (">i4", 4294967295.0), -32: (">f4", 1.0), -64: (">f8", 1.0)}
MOST_SIDE = 100_000
#: Names of FITS files: .fit, .fits and .fts in any case, for Spark's listings and for plain names.
FILES, _FILE_NAME = "*.{[fF][iI][tT],[fF][iI][tT][sS],[fF][tT][sS]}", re.compile(r".*\.(fit|fits|fts)$", re.I)
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([EeDd][+-]?\d+)?$")


class FitsError(ValueError):
    pass


def card_value(text: str) -> str:
    """The value of a card: '' is a quote inside quotes, / starts a comment outside them."""
    t = text.strip()
    if not t.startswith("'"):
        return t.split("/", 1)[0].strip()
    out, i = [], 1
    while i < len(t):
        if t[i] == "'":
            if t[i + 1 : i + 2] != "'":
                break
            i += 1
        out.append(t[i])
        i += 1
    return "".join(out).rstrip()


def number(cards: dict[str, str], key: str, default: float) -> float:
    """A float with E or D exponent; blank is the default, anything else an error."""
    t = cards.get(key, "").strip()
    if not t:
        return default
    if not _NUMBER.match(t):
        raise FitsError(f"{key} is not a number: {t}")
    return float(t.replace("D", "E").replace("d", "e"))


def read_header(data: bytes) -> dict:
    """width, height, channels, bitpix, bzero, bscale, bottom_up, header_bytes and all cards."""
    cards: dict[str, str] = {}
    for at in range(0, len(data) - CARD + 1, CARD):
        card = data[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            end = -(-(at + CARD) // BLOCK) * BLOCK
            break
        if card[8:10] == "= ":
            cards.setdefault(key, card_value(card[10:]))
    else:
        raise FitsError("no END card")
    bitpix, naxis = int(number(cards, "BITPIX", 0)), int(number(cards, "NAXIS", 0))
    if bitpix not in SAMPLES or naxis not in (2, 3):
        raise FitsError(f"BITPIX {bitpix} with {naxis} axes isn't read")
    dims = [int(number(cards, f"NAXIS{k + 1}", 0)) for k in range(naxis)]
    if not all(1 <= d <= MOST_SIDE for d in dims) or naxis == 3 and dims[2] not in (1, 3):
        raise FitsError(f"axes {dims} aren't read")
    return {
        "width": dims[0], "height": dims[1], "channels": dims[2] if naxis == 3 else 1, "bitpix": bitpix, "bzero": number(cards, "BZERO", 0.0), "bscale": number(cards, "BSCALE", 1.0),
        "bottom_up": cards.get("ROWORDER", "BOTTOM-UP").upper() != "TOP-DOWN", "header_bytes": end, "cards": cards,
    }


def decode(data: bytes, top_down: bool = True, clamp: bool = True) -> tuple[dict, np.ndarray]:
    """Header and float32 pixels [channel, y, x]; non-finite is 0. clamp=False keeps the linear range."""
    h = read_header(data)
    kind, top = SAMPLES[h["bitpix"]]
    n = h["width"] * h["height"] * h["channels"]
    if len(data) < h["header_bytes"] + n * np.dtype(kind).itemsize:
        raise FitsError("the file is cut off")
    a = np.frombuffer(data, kind, n, h["header_bytes"]).astype(np.float64) * h["bscale"] + h["bzero"]
    a = np.nan_to_num(a / top, nan=0.0, posinf=0.0, neginf=0.0).reshape(h["channels"], h["height"], h["width"])
    if clamp:
        a = a.clip(0, 1)
    return h, (a[:, ::-1] if top_down and h["bottom_up"] else a).astype(np.float32)


def encode(pixels: np.ndarray, frames: int = 0, exposure: float = 0.0, extra: dict[str, str] | None = None) -> bytes:
    """A float32 file, top-down, in padded blocks."""
    c, h, w = pixels.shape
    cards = [("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", "3" if c > 1 else "2"), ("NAXIS1", str(w)), ("NAXIS2", str(h)), *([("NAXIS3", str(c))] if c > 1 else []), ("ROWORDER", "'TOP-DOWN'")]
    cards += ([("STACKCNT", str(frames))] if frames else []) + ([("TOTALEXP", f"{exposure:g}")] if exposure else [])
    cards += [(k, "'" + v.replace("'", "''") + "'") for k, v in (extra or {}).items()]
    head = "".join((f"{k:<8}= " + (f"{v:<20}" if v.startswith("'") else f"{v:>20}")).ljust(CARD)[:CARD] for k, v in cards) + "END".ljust(CARD)
    body = np.ascontiguousarray(pixels, ">f4").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode("ascii") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _heads(files: DataFrame, path: str) -> DataFrame:
    """files (path, length, modificationTime and more) with head: the first HEAD bytes of each.

    Where the store can't be opened by range, files must be Spark's own listing, whose content is read.
    """
    if not store.opens(path):
        return files.withColumn("head", F.substring("content", 1, HEAD)).drop("content")
    listed = files.drop("content")

    def run(batches):
        for pdf in batches:
            # one file at a time: a batch of listings is many files
            for k in range(len(pdf)):
                one = pdf.iloc[k : k + 1]
                try:
                    head = store.head(one["path"].iloc[0], HEAD)
                except OSError:
                    head = b""
                yield one.assign(head=[head])

    return listed.mapInPandas(run, T.StructType([*listed.schema.fields, T.StructField("head", T.BinaryType())]))


def frames(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """One row a file with header and metadata columns; an unreadable file has its error instead."""

    def run(batches):
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False):
                try:
                    h = read_header(bytes(f.head))
                    out.append((f.path, f.length, f.modificationTime, h["width"], h["height"], h["channels"], h["bitpix"], h["cards"].get("BAYERPAT"), h["bottom_up"], h["header_bytes"], h["cards"], None))
                except FitsError as e:
                    out.append((f.path, f.length, f.modificationTime, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=FRAMES.names).astype({c: "Int32" for c in ("width", "height", "channels", "bitpix", "header_bytes")})

    return _heads(_files(spark, path, glob), path).mapInPandas(run, FRAMES)


def newest_metadata(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """(folder, path, name, extension, object, exposure_seconds): of each folder the newest file whose header can be read.

    Folders try their newest file together, those where it is cut off or being written their
    next newest, and so on: a folder with a readable newest file has one file opened. Only
    the folders that failed, and where they are, pass through the driver between rounds.
    Ties of time go to the greater name. Folders without a readable file are left out.
    """
    listed = _files(spark, path, glob).select("path", "modificationTime", "length") if store.opens(path) else _files(spark, path, glob)
    at = listed.withColumns({"folder": F.regexp_replace("path", "/[^/]*$", ""), "name": F.element_at(F.split("path", "/"), -1)})
    out, bound = None, None
    while True:
        left = at
        if bound is not None:
            failed = spark.createDataFrame(bound, "folder string, _time timestamp, _name string")
            left = at.join(failed, "folder").where(F.struct("modificationTime", "name") < F.struct("_time", "_name")).drop("_time", "_name")
        newest = left.groupBy("folder").agg(F.max_by(F.struct(*at.columns), F.struct("modificationTime", "name")).alias("f")).select("f.*")
        tried = _heads(newest, path).mapInPandas(_parsed, "folder string, path string, name string, modificationTime timestamp, header map<string,string>").persist()
        readable = tried.where("header IS NOT NULL")
        out = readable if out is None else out.unionByName(readable)
        bound = [tuple(r) for r in tried.where("header IS NULL").select("folder", "modificationTime", "name").collect()]
        if not bound:
            m = metadata(F.col("header"))
            return out.select("folder", "path", "name", F.lower(F.element_at(F.split("name", r"\."), -1)).alias("extension"), m["object"].alias("object"), m["exposure_seconds"].alias("exposure_seconds"))


def _parsed(batches):
    for pdf in batches:
        heads = []
        for head in pdf["head"]:
            try:
                heads.append(read_header(bytes(head))["cards"])
            except FitsError:
                heads.append(None)
        yield pdf[["folder", "path", "name", "modificationTime"]].assign(header=pd.Series(heads, index=pdf.index, dtype=object))


def pixel_rows(spark: SparkSession, path: str, glob: str = FILES, top_down: bool = True, clamp: bool = True) -> DataFrame:
    """(path, c, y, row): scanlines of the readable files, a file's rows yielded plane by plane."""

    def run(batches):
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                try:
                    _, a = decode(bytes(f.content), top_down, clamp)
                except FitsError:
                    continue
                for c in range(a.shape[0]):
                    for y in range(0, a.shape[1], 256):
                        part = a[c, y : y + 256]
                        yield pd.DataFrame({"path": f.path, "c": np.int32(c), "y": np.arange(y, y + len(part), dtype=np.int32), "row": list(part)})

    return _files(spark, path, glob).select("path", "content").mapInPandas(run, PIXEL_ROWS)


def pixels(rows: DataFrame) -> DataFrame:
    """The long view (path, c, y, x, v)."""
    return rows.select("path", "c", "y", F.posexplode("row").alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def write_frames(rows: DataFrame, keys: list[str], frames: str | None = None, exposure: str | None = None, cards: str | None = None) -> DataFrame:
    """(keys, content): one encoded file for each key of scanline rows; the caller stores the column.

    frames, exposure and cards name columns of rows with an image's STACKCNT, TOTALEXP and
    further text cards (a map). A group is one image.
    """
    extra = [c for c in (frames, exposure, cards) if c]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["c", "y"])
        a = np.array(pdf["row"].tolist(), np.float32).reshape(pdf["c"].nunique(), pdf["y"].nunique(), -1)
        return pd.DataFrame({**dict(zip(keys, ([k] for k in key))), "content": [encode(a, *(_card_values(pdf.iloc[0], frames, exposure, cards)))]})

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("content", T.BinaryType())])
    return rows.select(*keys, "c", "y", "row", *extra).groupBy(*keys).applyInPandas(one, schema)


def _card_values(first: pd.Series, frames: str | None, exposure: str | None, cards: str | None) -> tuple[int, float, dict[str, str]]:
    some = lambda name: first[name] if name and first[name] is not None and first[name] == first[name] else None
    return int(some(frames) or 0), float(some(exposure) or 0), dict(some(cards) or {})


def denoise_files(spark: SparkSession, path: str, into: str, strength: float, glob: str = FILES) -> DataFrame:
    """Reads linear files, denoises them and writes them under the same names into another folder: (path, written, error).

    Object, frames and exposure stay on the cards. A file that can't be read has its error.
    """
    from framelake.operators import filters

    def opened(batches):
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                try:
                    h, a = decode(bytes(f.content), clamp=False)
                    yield pd.DataFrame({"path": [f.path], "cards": [h["cards"]], "error": [None], "width": [h["width"]], "height": [h["height"]], "linear": [True], "pixels": [[p.ravel().astype(float) for p in a]]})
                except FitsError as e:
                    yield pd.DataFrame({"path": [f.path], "cards": [None], "error": [str(e)], "width": [0], "height": [0], "linear": [True], "pixels": [[]]})

    def closed(batches):
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False):
                name = None
                if f.error is None:
                    cards = dict(f.cards)
                    whole = lambda k: int(number(cards, k, 0))
                    a = np.array([np.asarray(p, float) for p in f.pixels]).reshape(len(f.pixels), int(f.height), int(f.width))
                    name = f"{into}/{f.path.rsplit('/', 1)[1]}"
                    store.write(name, encode(a.astype(np.float32), whole("STACKCNT"), number(cards, "TOTALEXP", 0.0), {k: cards[k] for k in ("OBJECT", "DATE-OBS") if cards.get(k)}))
                out.append((f.path, name, f.error))
            yield pd.DataFrame(out, columns=["path", "written", "error"])

    schema = "path string, cards map<string,string>, error string, width int, height int, linear boolean, pixels array<array<double>>"
    planes = _files(spark, path, glob).select("path", "content").mapInPandas(opened, schema)
    done = filters.denoise(planes, ["path", "cards", "error"], strength)
    return done.mapInPandas(closed, "path string, written string, error string")


def text_or_null(c: Column) -> Column:
    """Trimmed, one pair of quotes off, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), "^'(.*)'$", "$1")), F.lit(""))


def metadata(header: Column) -> Column:
    """The 14 metadata fields of a header map; numbers that do not parse are null."""
    s = lambda *keys: F.coalesce(*[text_or_null(F.try_element_at(header, F.lit(k))) for k in keys])
    n = lambda *keys: F.translate(s(*keys), "Dd", "EE").try_cast("double")
    return F.struct(
        s("OBJECT").alias("object"), n("RA").alias("ra"), n("DEC").alias("dec"), n("FOCALLEN").alias("focal_length_mm"), n("XPIXSZ", "YPIXSZ").alias("pixel_size_um"), s("INSTRUME").alias("instrument"),
        s("TELESCOP").alias("telescope"), s("FILTER").alias("filter"), n("EXPTIME", "EXPOSURE").alias("exposure_seconds"), s("DATE-OBS").alias("date_obs"), n("GAIN").alias("gain"), n("CCD-TEMP").alias("ccd_temp_c"), n("SITELAT").alias("site_lat"), n("SITELONG").alias("site_lon"),
    )


def observed_at(date_obs: Column, mtime: Column) -> Column:
    """DATE-OBS in any of its forms as UTC, else the file's time."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    bare = F.regexp_replace(date_obs, "Z$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms], mtime)


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


#: What filters on a path may ask of it, by their class.
_ASKS = {
    EqualTo: lambda path, v: path == v,
    In: lambda path, v: path in v,
    StringStartsWith: lambda path, v: path.startswith(v),
    StringEndsWith: lambda path, v: path.endswith(v),
    StringContains: lambda path, v: v in path,
}


class _Reader(DataSourceReader):
    """Reads heads by range."""

    def __init__(self, path: str, most: int, tasks: int) -> None:
        self.root, self.most, self.tasks = path, most, tasks
        self.asked: list = []

    def partitions(self):
        files, root = store.at(self.root)
        found = store.listing(self.root, recursive=True)
        if found is None:
            found = [files.get_file_info(root)]
        paths = sorted(f.path for f in found if _FILE_NAME.match(f.path) and all(_ASKS[type(a)](f.path, a.value) for a in self.asked))
        return [_Part(paths[k :: self.tasks]) for k in range(min(self.tasks, len(paths)))]

    def read(self, partition):
        files, _ = store.at(self.root)
        for path in partition.paths:
            with files.open_input_file(path) as f:
                head = f.read_at(min(self.most, f.size()), 0)
            try:
                h = read_header(head)
            except FitsError:
                continue
            yield path, h["width"], h["height"], h["channels"], h["bitpix"], h["cards"]


class _Choosy(_Reader):
    """Files that filters on path exclude are not opened."""

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _ASKS and f.attribute == ("path",):
                self.asked.append(f)
            else:
                yield f


class FitsDataSource(DataSource):
    """spark.read.format("fits"): headers alone, reading at most header_bytes of each file, in tasks many partitions.

    With option filters=true, filters on path keep files from being opened; Spark wants
    spark.sql.python.filterPushdown.enabled set for that.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "path string, width int, height int, channels int, bitpix int, header map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        kind = _Choosy if self.options.get("filters", "false").lower() == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("header_bytes", HEAD)), int(self.options.get("tasks", 64)))
