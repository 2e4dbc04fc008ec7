"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles and a signature of ``SYMBOLS``
   minima, cut to ``BITS`` bits each. Texts with equal sets form one class and go on
   as one node; copies are never expanded into pairs.
2. Multi-index join. The signature is split into ``CHUNKS`` chunks. By the pigeonhole
   principle two signatures that differ in at most ``2 * CHUNKS - 1`` symbols have a
   chunk in which they differ in at most one, so each chunk is indexed once for each
   symbol that may be wrong, with that symbol left out. All pairs within that
   distance share a key; sets with a Jaccard index of 0.75 share one with a
   probability of 1 - 6e-6, as each chunk fits with 0.63.
3. Nodes that share a key, directly or through others, form a cluster. A cluster is
   dealt in blocks of bounded weight; each pair of blocks is one group of rows, in
   which exact intersections of the full sets are counted. Only a spanning forest of
   the links found is returned, so the output is linear in the input.
4. The links' connected components give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamledger.llm.common import (
    BITMAP,
    bitmap,
    connected_components,
    fresh,
    holds,
    lasting,
    lists,
    mix,
    numbered,
    raw_bytes,
    scratch,
    shingles,
    sieved,
    spread,
    stage,
    text_or_empty,
    word_hashes,
)

WIDTH = 5
CHUNKS, CHUNK = 12, 5
SYMBOLS, BITS = CHUNKS * CHUNK, 16
PERCENT = 75
#: Shingles in a block of a cluster; a group of rows holds two blocks, of about 4 MB each unless one text is larger.
BLOCK_WEIGHT = 500_000
_ODD = (mix(np.arange(1000, 1000 + SYMBOLS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their offsets."""
    data, offsets = raw_bytes(texts)
    hashes, at = shingles(*word_hashes(data, offsets), width)
    own = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    sizes = np.array([len(x) for x in own], np.int64)
    return (np.concatenate(own) if own else hashes), np.concatenate([[0], np.cumsum(sizes)])


def _digests(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, by sums over its members."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix(flat + np.uint64(7)), mix(flat ^ np.uint64(0x5DEECE66D)))]
    return tuple((mix(t[at[1:]] - t[at[:-1]] + np.diff(at).astype(np.uint64))).view(np.int64) for t in total)


def _signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` minima of each non-empty set, as rows."""
    full = np.flatnonzero(np.diff(at))
    small = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(at) - 1, SYMBOLS), np.uint16)
    # a few thousand members at a time stay in the processor's cache
    first = 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(at[full], at[full[first]] + 32768)))
        rows = full[first:last]
        own, start = small[at[rows[0]] : at[rows[-1] + 1]], at[rows] - at[rows[0]]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(own * _ODD[k], start)
            out[rows, k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        first = last
    return out


_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary())])


def _sketch(width: int):
    def run(batch: pa.RecordBatch):
        flat, at = _sets(batch.column("text"), width)
        d1, d2 = _digests(flat, at)
        signature = [x.tobytes() for x in _signatures(flat, at)]
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_shingles": np.diff(at), "d1": d1, "d2": d2, "signature": signature}

    return lambda it: spread(it, run, _ROWS)


_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature's chunks, with each symbol of a chunk left out in turn."""
    for batch in it:
        node = batch.column("node").to_numpy()
        s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        for c in range(CHUNKS):
            for out in range(CHUNK):
                kept = [c * CHUNK + k for k in range(CHUNK) if k != out]
                key = np.zeros(len(s), np.uint64)
                for k in kept:
                    key = (key << np.uint64(BITS)) | s[:, k]
                key = mix(key + np.uint64((c * CHUNK + out + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], schema=_KEYS)


_SETS = pa.schema([("cluster", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("members", pa.list_(pa.int64()))])
_DEALT = "cluster long, blocks int, block int, node long, members array<long>"


def _full_sets(width: int):
    def run(batch: pa.RecordBatch):
        flat, at = _sets(batch.column("text"), width)
        return {c: batch.column(c) for c in ("cluster", "blocks", "block", "node")} | {"members": lists(flat.view(np.int64), at)}

    return lambda it: spread(it, run, _SETS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(nodes: np.ndarray, blocks: np.ndarray, members: np.ndarray, at: np.ndarray, cross: bool, percent: int):
    """A spanning forest of the links among one group's sets.

    One set at a time is marked, and its intersections with all sets that are not yet
    linked with it are counted in one vectorised sum.
    """
    n = len(nodes)
    codes = np.unique(members, return_inverse=True)[1]
    sizes = np.diff(at)
    root = np.arange(n)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    found = []
    for i in range(n - 1):
        near = (root[i + 1 :] != root[i]) & (100 * sizes[i + 1 :] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[i + 1 :])
        if cross:
            near &= blocks[i + 1 :] != blocks[i]
        rest = np.flatnonzero(near) + i + 1
        if not len(rest):
            continue
        own = codes[at[i] : at[i + 1]]
        mark[own] = True
        if 4 * len(rest) > n:
            common = np.add.reduceat(mark[codes[at[i + 1] :]].astype(np.int32), at[i + 1 : -1] - at[i + 1])[rest - i - 1]
        else:
            start = np.concatenate([[0], np.cumsum(sizes[rest])])
            where = np.arange(start[-1]) + np.repeat(at[rest] - start[:-1], sizes[rest])
            common = np.add.reduceat(mark[codes[where]].astype(np.int32), start[:-1])
        mark[own] = False
        for j in rest[100 * common >= percent * (sizes[i] + sizes[rest] - common)]:
            if root[j] != root[i]:
                found.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
    return found


def _compare(percent: int):
    """Groups of rows arrive whole and one after the other, as they are sorted within their partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            lists_ = rows.column("members").chunk(0)
            at = lists_.offsets.to_numpy().astype(np.int64)
            found = _links(rows.column("node").to_numpy(), rows.column("block").to_numpy(), lists_.values.to_numpy()[at[0] : at[-1]], at - at[0], key[1] != key[2], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_LINKS)

        for batch in it:
            columns = [batch.column(c).to_numpy() for c in ("cluster", "lo", "hi")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
            for first, last in zip([0, *change], [*change, batch.num_rows], strict=True):
                if first == last:
                    continue
                now = tuple(int(x[first]) for x in columns)
                if held and now != key:
                    yield done()
                    held = []
                key = now
                held.append(batch.slice(first, last - first))
        if held:
            yield done()

    return run


def _grouped(docs: DataFrame, row: str, width: int, percent: int) -> DataFrame:
    """``docs``, staged with their numbers in the column ``row``, to ``row, doc_id, n_shingles, first``; ``first(none, doc_id, row)`` is the first row of the component, by id (null last) and row."""
    source = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = stage(source.mapInArrow(_sketch(width), "row long, doc_id long, n_shingles long, d1 long, d2 long, signature binary"), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min(own).alias("first"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = classes.select("node", "signature").mapInArrow(_index, "key long, node long")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    near = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = stage(connected_components(near).withColumnRenamed("component", "cluster"), "clusters")

    members = clusters.join(classes.select("node", "n", F.col("first.row").alias("row")), "node")
    weight = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_WEIGHT).cast("int").alias("blocks"))
    members = stage(members.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    # rows that are no candidates fall out before the texts are shuffled, as far as a bitmap of bounded size tells them
    words, size = bitmap(members, F.xxhash64("row"), BITMAP)
    likely = source.where(holds(words.scalar(), size, F.xxhash64("row")))
    # candidates grow with the corpus, so they are never broadcast, and the plan is the same at every size
    sets = likely.join(members.hint("merge"), "row").select("cluster", "blocks", "block", "node", "text").mapInArrow(_full_sets(width), _DEALT)
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "members"
    )
    links = stage(
        dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node").mapInArrow(_compare(percent), "a long, b long"),
        "links",
    )
    found = connected_components(links)

    labelled = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = labelled.groupBy("component").agg(F.min("first").alias("first"))
    by_class = labelled.drop("first").join(firsts, "component").select("d1", "d2", "first")
    full = rows.where("n_shingles > 0").join(by_class, ["d1", "d2"]).select("row", "doc_id", "n_shingles", "first")
    return full.unionByName(rows.where("n_shingles = 0").select("row", "doc_id", "n_shingles", own.alias("first")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``doc_id, n_shingles, component_id, kept``, one row for each row.

    Texts are compared in lower case (A-Z only), by words between ASCII white space.
    Null text counts as empty; a row without words has no shingles and stands alone.
    Rows with one ``doc_id`` are compared as any others. A null ``doc_id`` takes part by
    its text; its component is the smallest id in it, null if no member has one, and it is
    kept only then. Other columns are ignored, whatever their names.
    """
    out = _grouped(numbered(docs.select("doc_id", "text"), "row"), "row", width, percent).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """The first row of each component, with the columns of ``docs``: by smallest id, then in the order read.

    ``row`` is a column that numbers the rows, whenever they are read; without it a numbered copy is written.
    """
    own, gone = fresh(docs, "own_row"), fresh(docs, "gone_row")
    rows, own = (docs, row) if row else (numbered(docs, own), own)
    with scratch(docs.sparkSession):
        # the rows that have a first one before them: fewer than those that stay, so few texts need be shuffled
        others = _grouped(rows, own, width, percent).where(F.col("row") != F.col("first.row")).select(F.col("row").alias(gone))
        with lasting():
            others = stage(others, "firsts")
    alone, likely = sieved(rows, F.xxhash64(own), others, F.xxhash64(gone))
    return alone.union(likely.join(others.hint("merge"), F.col(own) == F.col(gone), "left_anti")).select(*docs.columns)
