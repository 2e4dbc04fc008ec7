"""Helpers shared by the training-data operators: staging and vectorised text hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
#: Most bits of the bitmap by which a scan passes over rows that a join can't want, and the rows that a table of fixed size comes in.
BITMAP, CHUNKS = 1 << 24, 1 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine, as in tests, a temporary folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="streamledger-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged within is deleted at the end, but for what is ``lasting``; nothing that is returned may read the rest."""
    scopes = (*_SCOPES.get(), f"scratch-{uuid.uuid4().hex}")
    token = _SCOPES.set(scopes)
    try:
        yield
    finally:
        _SCOPES.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([shared_dir(spark), "staged", *scopes]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def lasting() -> Iterator[None]:
    """What is staged within stays beyond the end of the ``scratch`` around it."""
    token = _SCOPES.set(_SCOPES.get()[:-1])
    try:
        yield
    finally:
        _SCOPES.reset(token)


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs the rerun of its tasks only; what is staged stays readable, within
    ``scratch`` until its end, or beyond it if it is ``lasting``.
    """
    path = "/".join([shared_dir(df.sparkSession), "staged", *_SCOPES.get(), f"{name}-{uuid.uuid4().hex}"])
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that numbers its rows as read, staged.

    The numbers depend on how a scan is split, which two plans may do differently; what
    needs them twice must read them from what was written once.
    """
    # whole texts, which stay on disk: a stronger compression than the default
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered", {"compression": "zstd"})


def located(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that numbers its rows by their file and their place in it.

    For tables read from Parquet files with nothing done to them since: their numbers are the same
    however a scan is split, so no copy of the rows is written. Others are ``numbered``.
    """
    file, at, of = (fresh(df, x) for x in ("in_file", "at_row", "of_file"))
    try:
        place = df.metadataColumn("_metadata")
        rows = df.select("*", place["file_path"].alias(file), place["row_index"].alias(at))
    except AnalysisException:
        return numbered(df, name)
    n, every = F.count(F.lit(1)), F.sum(F.col(at))
    whole = (n == F.max(at) + 1) & (2 * every == n * (n - 1))
    # one row for each file
    files = stage(rows.groupBy(F.col(file).alias(of)).agg(whole.alias("whole")).withColumn("number", F.row_number().over(Window.orderBy(of))), "files")
    if not files.where("not whole").isEmpty():
        # rows of the files were left out or come more than once
        return numbered(df, name)
    number = F.shiftleft(F.col("number").cast("long"), 40) + F.col(at)
    return rows.join(F.broadcast(files), F.col(file) == F.col(of)).select(*[df[c] for c in df.columns], number.alias(name))


def bitmap(rows: DataFrame, of: Column, most: int, staged: bool = True) -> tuple[DataFrame, int]:
    """One row ``words``, longs in which two bits of the hash ``of`` of each row are set, and the number of bits."""
    size = min(most, max(1 << 12, 1 << (16 * rows.count()).bit_length()))
    bit = F.explode(F.array(of.bitwiseAND(size - 1), F.shiftrightunsigned(of, 32).bitwiseAND(size - 1)))
    known = rows.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("slot"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("word"))
    every = rows.sparkSession.range(size // 64).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("word"))
    slots = known.unionByName(every).groupBy("slot").agg(F.bit_or("word").alias("word"))
    chunk = F.floor(F.col("slot") / max(1, size // 64 // CHUNKS))
    chunks = slots.groupBy(chunk.alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "word"))), lambda x: x["word"]).alias("words"))
    # one row of bounded size
    row = chunks.agg(F.sort_array(F.collect_list(F.struct("chunk", "words"))).alias("a")).select(F.flatten("a.words").alias("words"))
    return (stage(row, "bitmap") if staged else row), size


def holds(words: Column, size: int, of: Column) -> Column:
    """Whether both bits of ``of`` are set: always for what the bitmap was made of, rarely for others as long as it isn't full."""
    held = lambda bit: F.getbit(words[F.shiftright(bit, 6).cast("int")], bit.bitwiseAND(63).cast("int")) == 1
    return held(of.bitwiseAND(size - 1)) & held(F.shiftrightunsigned(of, 32).bitwiseAND(size - 1))


def sieved(rows: DataFrame, key: Column, few: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` that can't meet ``few``, and those that may, to be joined with it; ``key`` and ``of`` are hashes, equal where rows meet.

    A bitmap of bounded size tells them apart, so that a join need not shuffle rows it doesn't change.
    A full one tells none. ``few`` is staged; the bitmap is made of it whenever the rows are read.
    """
    words, size = bitmap(few, of, BITMAP, staged=False)
    likely = holds(words.scalar(), size, key)
    return rows.where(~likely), rows.where(likely)


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row.

    A filter or projection over a plain column is rewritten to hold the column's whole
    expression; over the output of a generator of one row it can't be.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``, component the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is
    a join and an aggregation by node with map-side combining; nothing is collected
    but one row of two numbers per round, which tells whether the edges changed.
    """
    stars = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    stars = stage(stars, "stars")
    before = None
    while True:
        seen = stars.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (seen["n"], seen["h"]) == before or seen["n"] == 0:
            break
        before = (seen["n"], seen["h"])
        # large star: what a node's larger neighbours can reach through it
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node points at the least of its smaller neighbours
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = stage(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# ---- vectorised hashing of texts inside Arrow batches -------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array (null: empty) and its n + 1 offsets."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array, most: int = 1 << 21):
    """Slices ``(first, last)`` of the array with about ``most`` bytes each (a longer text stands alone)."""
    if len(texts) == 0:
        return
    sizes = raw_bytes(texts)[1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + most, "right")) - 1)
        yield first, last
        first = last


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums c with which ``(c[e] - c[s]) * inverse[s]`` is a hash of bytes s..e, wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= power[: len(data)]
    np.cumsum(values, out=total[1:])
    return total, inverse


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = True):
    """64-bit hashes of the words of all texts, and the n + 1 word offsets of the texts.

    A word is a longest run of bytes of which ``is_word`` is true, within one text.
    """
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    now, before = inside[1:], inside[:-1]  # at byte i, and at byte i - 1
    start = np.flatnonzero(now & (~before | cut))
    end = np.flatnonzero(before & (~now | cut))
    total, inverse = prefix_hash(data)
    hashes = mix((total[end] - total[start]) * inverse[start])
    return hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int):
    """Hashes of all ``width``-word windows; a text of fewer words has its whole sequence as one.

    Returns the hashes and the n + 1 offsets of the texts; texts without words have none.
    """
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    # the start, in words, of each shingle
    start = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(offsets[:-1], count)
    length = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    out = np.zeros(at[-1], np.uint64)
    for k in range(width):
        part = padded[start + k] * factors[k]
        if k:
            part[length <= k] = 0
        out += part
    out += length.astype(np.uint64)
    return mix(out), at


def spread(it, fn, schema: pa.Schema):
    """Apply ``fn(batch) -> dict of columns`` to each Arrow batch in bounded slices."""
    for batch in it:
        for first, last in pieces(batch.column("text")):
            out = fn(batch.slice(first, last - first))
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in schema], schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list array over one flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
