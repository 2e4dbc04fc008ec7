"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over ``SPAN`` consecutive words: the words at its ones are hashed,
those at its zeros may be anything, so a substituted word does not hide a passage.
Every window of every text is hashed under every mask. The benchmark's hashes become
a bitmap of fixed size, which each task uses to let only likely hits pass; the hits
are then joined with the benchmark's hashes, and each joined hit is verified around
its place on the full words: the best run along that alignment gains a point for each
equal word and loses ``PENALTY`` for each substituted one, and must reach
``LEAST_POINTS`` or 70 % of a shorter item. Items of under ``SPAN`` words have no window:
they match where all their words stand, found by one hash of the whole item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamledger.llm.common import fresh, lists, mix, pieces, raw_bytes, sieved, stage, text_or_empty, word_hashes

MASKS = ("1101101011", "1110010111", "1011011101")
SPAN = 10
#: Words looked at on either side of a hit.
REACH = 64
LEAST_POINTS, PENALTY, SHARE = 13, 2, 0.7
#: The bitmap has 2 ** BITS bits, 4 MB, whatever the benchmark's size; a full one lets more pass, and the join still decides.
BITS = 25
#: Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case (A-Z).
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True
_OFFSETS = [[k for k, x in enumerate(m) if x == "1"] for m in MASKS]
_FACTORS = mix(np.arange(1, 1 + len(MASKS) * SPAN, dtype=np.uint64)).reshape(len(MASKS), SPAN) | np.uint64(1)
_WHOLE = mix(np.arange(1001, 1001 + SPAN, dtype=np.uint64)) | np.uint64(1)


def _starts(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[int, np.ndarray]:
    """The number of windows of ``width`` words, and the starts of those inside one text."""
    starts = max(0, len(words) - width + 1)
    inside = np.ones(starts, bool)
    for k in range(1, width):
        over = offsets[1:] - k
        inside[over[(over >= 0) & (over < starts)]] = False
    return starts, np.flatnonzero(inside)


def _seeds(words: np.ndarray, offsets: np.ndarray):
    """For each mask, the starts of all windows inside one text, and their hashes."""
    starts, at = _starts(words, offsets, SPAN)
    for own, factors in zip(_OFFSETS, _FACTORS, strict=True):
        h = np.zeros(starts, np.uint64)
        for k in own:
            h += words[k : k + starts] * factors[k]
        yield at, mix(h[at])


def _wholes(words: np.ndarray, offsets: np.ndarray, lengths):
    """The same for windows of each of ``lengths``, under SPAN words, by all of their words."""
    for n in lengths:
        starts, at = _starts(words, offsets, n)
        h = np.full(starts, n, np.uint64)
        for k in range(n):
            h += words[k : k + starts] * _WHOLE[k]
        yield at, mix(h[at])


_BENCH = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])


def _bench_seeds(it):
    for batch in it:
        for first, last in pieces(batch.column("text")):
            part = batch.slice(first, last - first)
            words, offsets = word_hashes(*raw_bytes(part.column("text")), WORD)
            size, wholes = np.diff(offsets), []
            for n in np.unique(size[(size > 0) & (size < SPAN)]):
                for at, h in _wholes(words, offsets, [n]):
                    own = np.isin(at, offsets[:-1][size == n])
                    wholes.append((at[own], h[own]))
            for at, h in [*_seeds(words, offsets), *wholes]:
                item = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("item_id").take(pa.array(item)), pa.array((at - offsets[item]).astype(np.int32))], schema=_BENCH)


_ITEMS = pa.schema([("item_id", pa.int64()), ("item", pa.list_(pa.int64()))])


def _item_words(it):
    for batch in it:
        for first, last in pieces(batch.column("text")):
            part = batch.slice(first, last - first)
            words, offsets = word_hashes(*raw_bytes(part.column("text")), WORD)
            yield pa.RecordBatch.from_arrays([part.column("item_id").cast(pa.int64()), lists(words.view(np.int64), offsets)], schema=_ITEMS)


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])


def _segments(bitmap, lengths):
    """Stretches of texts around likely hits: their words, and the hits' places and hashes."""
    low = np.uint64((1 << BITS) - 1)

    def run(it):
        bits = bitmap.value
        isset = lambda x: (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        for batch in it:
            for first, last in pieces(batch.column("text")):
                part = batch.slice(first, last - first)
                words, offsets = word_hashes(*raw_bytes(part.column("text")), WORD)
                places, hashes = [], []
                for at, h in [*_seeds(words, offsets), *_wholes(words, offsets, lengths)]:
                    likely = np.flatnonzero(isset(h & low))
                    likely = likely[isset((h[likely] >> np.uint64(BITS)) & low)]
                    places.append(at[likely])
                    hashes.append(h[likely])
                places, hashes = np.concatenate(places), np.concatenate(hashes)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                places, hashes = places[order], hashes[order]
                text = np.searchsorted(offsets, places, "right") - 1
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (np.diff(places) > 2 * REACH)])
                head = np.flatnonzero(new)
                tail = np.concatenate([head[1:], [len(places)]]) - 1
                own = text[head]
                start = np.maximum(places[head] - REACH, offsets[own])
                end = np.minimum(places[tail] + SPAN + REACH, offsets[own + 1])
                size = end - start
                flat = np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                number = np.cumsum(new) - 1
                hit_at = np.concatenate([head, [len(places)]])
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows),
                        part.column("digest").take(rows),
                        pa.array(start - offsets[own]),
                        lists(words[flat].view(np.int64), np.concatenate([[0], np.cumsum(size)])),
                        lists((places - start[number]).astype(np.int32), hit_at),
                        lists(hashes.view(np.int64), hit_at),
                    ],
                    schema=_SEGMENTS,
                )

    return run


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The benchmark's hashes in 2 ** BITS bits; at most 2 ** (BITS - 6) words come to the driver."""
    slots = seeds.select(F.explode(F.array(F.col("hash").bitwiseAND((1 << BITS) - 1), F.shiftright("hash", BITS).bitwiseAND((1 << BITS) - 1))).alias("slot"))
    words = (
        slots.groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark passages in texts: ``doc_id, digest, item_id, matched, points, first_word``.

    One row for each text (``digest`` is xxhash64 of it) and item that it holds; rows
    with one id and one text are one. ``matched`` counts equal words in the best run,
    ``first_word`` is the run's first word in the text. Null texts are empty and hold
    nothing; items with fewer than ``SPAN`` words match by all their words in a row, those
    without words nothing; items with a null id count as any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text"))
    seeds = stage(items.mapInArrow(_bench_seeds, "hash long, item_id long, at int"), "seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    item_words = stage(items.mapInArrow(_item_words, "item_id long, item array<long>").where(F.size("item") > 0), "items")
    # at most SPAN - 1 rows
    lengths = sorted(r["n"] for r in item_words.select(F.size("item").alias("n")).where(F.col("n") < SPAN).distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("digest"), text_or_empty("text").alias("text"))
    segments = texts.mapInArrow(_segments(bitmap, lengths), "doc_id long, digest long, start long, words array<long>, hits array<int>, hashes array<long>")
    segments = stage(segments.withColumn("segment", F.monotonically_increasing_id()), "segments")
    hits = segments.select("segment", F.explode(F.arrays_zip("hits", "hashes")).alias("h")).select("segment", F.col("h.hits").alias("hit"), F.col("h.hashes").alias("hash"))
    # one alignment for each segment, item and diagonal, however many seeds agree on it
    aligned = hits.join(seeds, "hash").select("segment", "item_id", (F.col("hit") - F.col("at")).alias("shift")).distinct()
    pairs = aligned.withColumnRenamed("item_id", "own").join(item_words, F.col("own").eqNullSafe(F.col("item_id"))).join(segments, "segment")
    # the best run along the diagonal: points, equal words and first place, of the best so far and of the run that ends here
    best = F.expr(f"""
        aggregate(
          sequence(greatest(0, -shift), least(size(item), size(words) - shift) - 1),
          named_struct('p', 0, 'm', 0, 'f', 0, 'best', 0, 'matched', 0, 'first', 0),
          (a, k) -> named_struct(
            'p', greatest(0, a.p) + if(item[k] = words[k + shift], 1, -{PENALTY}),
            'm', if(a.p <= 0, 0, a.m) + if(item[k] = words[k + shift], 1, 0),
            'f', if(a.p <= 0, k, a.f),
            'best', greatest(a.best, greatest(0, a.p) + if(item[k] = words[k + shift], 1, -{PENALTY})),
            'matched', if(greatest(0, a.p) + if(item[k] = words[k + shift], 1, -{PENALTY}) > a.best, if(a.p <= 0, 0, a.m) + if(item[k] = words[k + shift], 1, 0), a.matched),
            'first', if(greatest(0, a.p) + if(item[k] = words[k + shift], 1, -{PENALTY}) > a.best, if(a.p <= 0, k, a.f), a.first)))
    """)
    return (
        pairs.withColumn("run", best)
        .where(F.col("run.best") >= F.when(F.size("item") < SPAN, F.size("item")).otherwise(F.least(F.lit(LEAST_POINTS), F.ceil(F.size("item") * SHARE))))
        .groupBy("doc_id", "digest", "item_id")
        .agg(F.max(F.struct(F.col("run.matched").alias("matched"), F.col("run.best").alias("points"), (-(F.col("start") + F.col("run.first") + F.col("shift"))).alias("before"))).alias("top"))
        .select("doc_id", "digest", "item_id", F.col("top.matched").alias("matched"), F.col("top.points").alias("points"), (-F.col("top.before")).alias("first_word"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage, with all their columns."""
    own, digest = fresh(docs, "leak_id"), fresh(docs, "leak_digest")
    leaks = overlaps(docs, benchmark).select(F.col("doc_id").alias(own), F.col("digest").alias(digest)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty("text")) == F.col(digest))
    leaks = stage(leaks, "leaks")
    alone, likely = sieved(docs, F.xxhash64(F.col("doc_id").cast("long")), leaks, F.xxhash64(own))
    return alone.union(likely.join(leaks.hint("merge"), same, "left_anti"))
