"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Wang and Manning's NB-SVM form with a logistic loss: a text's features are the
n-grams that it holds, each worth its log-count ratio between toxic and clean
training texts, and a regularised logistic regression is fitted on these.

Only the fit is bounded: at most about ``SAMPLE`` labelled texts of each class are
drawn, by a hash of their ids; the drawn rate is taken back out of the intercept.
Counting and feature extraction run as Spark jobs over the sample; the driver sees
``FEATURES`` counts and a few indices per sampled text. Scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamledger.llm.common import lists, pieces, prefix_hash, stage, text_or_empty

GRAMS = (4, 5)
SAMPLE = 4_000
FEATURES = 50_000
#: A feature stands in so many training texts at least, and its ratio is so far from 0.
LEAST_TEXTS, LEAST_RATIO = 3, 1.0
THRESHOLD = 0.3
_SLOTS = 22


def _grams(texts: pa.Array):
    """32-bit hashes of all character n-grams of lower-cased texts, and the text of each."""
    texts = pc.utf8_lower(texts.fill_null(""))
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    total, inverse = prefix_hash(points)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for n in GRAMS:
        if len(points) < n:
            continue
        starts = len(points) - n + 1
        hashed = (total[n:] - total[:starts]) * inverse[:starts]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        inside = np.ones(starts, bool)
        for k in range(1, n):  # windows that would run over a text's end
            over = ends - k
            inside[over[(over >= 0) & (over < starts)]] = False
        yield (hashed >> np.uint64(32)).astype(np.uint32), inside, owner[:starts]


_COUNTS = pa.schema([("gram", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count(it):
    for batch in it:
        for first, last in pieces(batch.column("text")):
            part = batch.slice(first, last - first)
            label = part.column("toxic").to_numpy().astype(bool)
            for gram, inside, owner in _grams(part.column("text")):
                pair = np.unique((gram[inside].astype(np.uint64) << np.uint64(31)) | owner[inside].astype(np.uint64))
                gram, at, both = np.unique(pair >> np.uint64(31), return_index=True, return_counts=True)
                if len(gram):
                    toxic = np.add.reduceat(label[(pair & np.uint64((1 << 31) - 1)).astype(np.int64)].astype(np.int64), at)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(toxic), pa.array(both - toxic)], schema=_COUNTS)


class _Lookup:
    """Positions of known n-grams among the features, which are sorted."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.slot = np.zeros(1 << _SLOTS, bool)
        self.slot[ids >> np.uint32(32 - _SLOTS)] = True

    def found(self, texts: pa.Array):
        """Distinct (text, feature) pairs."""
        pairs = []
        for gram, inside, owner in _grams(texts):
            at = np.flatnonzero(self.slot[gram >> np.uint32(32 - _SLOTS)] & inside)
            if len(at) and len(self.ids):
                where = np.minimum(np.searchsorted(self.ids, gram[at]), len(self.ids) - 1)
                known = self.ids[where] == gram[at]
                pairs.append(owner[at[known]].astype(np.int64) * len(self.ids) + where[known])
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))


_INDEXED = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int64()))])


def _indexed(ids):
    def run(it):
        lookup = _Lookup(ids.value)
        for batch in it:
            for first, last in pieces(batch.column("text")):
                part = batch.slice(first, last - first)
                text, feature = lookup.found(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), lists(feature, np.searchsorted(text, np.arange(part.num_rows + 1)))], schema=_INDEXED)

    return run


def _fit(label: np.ndarray, at: np.ndarray, feature: np.ndarray, ratio: np.ndarray, penalty: float = 1e-3, steps: int = 400):
    """Weights and intercept of a logistic regression, by accelerated gradient descent."""
    n, width = len(label), len(ratio)
    row = np.repeat(np.arange(n), np.diff(at))
    value = ratio[feature]
    times = lambda w: np.bincount(row, value * w[feature], n)
    back = lambda e: np.bincount(feature, value * e[row], width)
    v = np.ones(width)
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / ((np.linalg.norm(back(times(v))) + n) / (4 * n) + penalty)
    w, b, w_old, b_old = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(steps):
        m = t / (t + 3)
        wy, by = w + m * (w - w_old), b + m * (b - b_old)
        e = 1 / (1 + np.exp(-np.clip(times(wy) + by, -500, 500))) - label
        w_old, b_old = w, b
        w, b = wy - step * (back(e) / n + penalty * wy), by - step * e.mean()
    return w * ratio, b


class Model:
    """Sorted n-gram hashes, a weight for each, and the intercept."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, intercept: float):
        self.ids, self.weights, self.intercept = ids, weights, intercept


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels(doc_id, toxic)`` and the texts of ``docs(doc_id, text)`` with these ids.

    Rows with a null id or label teach nothing; of several labels or texts for one id
    the largest label and the smallest text count. Without both classes the model is
    a constant, the smoothed rate of toxic labels.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.withColumn("toxic", F.when(F.col("toxic") > 0, 1).otherwise(0))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_clean, all_toxic = counts.get(0, 0), counts.get(1, 0)
    flat = Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log((all_toxic + 1) / (all_clean + 1))))
    if not all_clean or not all_toxic:
        return flat
    rate = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / all_toxic)).otherwise(min(1.0, SAMPLE / all_clean))
    drawn = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < F.ceil(rate * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), text_or_empty("text").alias("text"))
    # the drawn ids are bounded by SAMPLE for each class, so they can be sent to every task
    sample = texts.join(F.broadcast(drawn), "label_id").groupBy("label_id", "toxic").agg(F.min("text").alias("text"))
    sample = stage(sample.select("toxic", "text"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return flat
    grams = sample.mapInArrow(_count, "gram long, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    seen = F.col("t") / toxic + F.col("c") / clean
    best = (
        grams.where(F.col("t") + F.col("c") >= LEAST_TEXTS)
        .select("gram", ratio.alias("ratio"), seen.alias("seen"))
        .where(F.abs("ratio") >= LEAST_RATIO)
        .orderBy((F.abs("ratio") * F.col("seen")).desc(), "gram")
        .limit(FEATURES)
        .toArrow()
    )
    order = np.argsort(best.column("gram").to_numpy())
    ids = best.column("gram").to_numpy()[order].astype(np.uint32)
    rows = sample.mapInArrow(_indexed(spark.sparkContext.broadcast(ids)), "toxic int, features array<long>").toArrow().combine_chunks()
    features = rows.column("features").combine_chunks()
    features = features.chunk(0) if isinstance(features, pa.ChunkedArray) else features
    at = features.offsets.to_numpy().astype(np.int64)
    w, b = _fit(rows.column("toxic").to_numpy().astype(float), at - at[0], features.values.to_numpy()[at[0] : at[-1]], best.column("ratio").to_numpy()[order])
    return Model(ids, w, b + float(np.log(all_toxic / all_clean) - np.log(toxic / clean)))


def _scores(model):
    def run(it):
        m = model.value
        lookup = _Lookup(m.ids)
        for batch in it:
            for first, last in pieces(batch.column("text")):
                part = batch.slice(first, last - first)
                text, feature = lookup.found(part.column("text"))
                z = np.bincount(text, m.weights[feature], part.num_rows) + m.intercept
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*part.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's ``doc_id`` and ``score``; a null or empty text scores by the intercept alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def split_of(column: str):
    """The remainder that tells training ids (0, 1, 3) from held-out ones (2)."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 4, F.lit(0))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; held-out labels are never read."""
    model = train(docs, labels.where(split_of("doc_id") != 2))
    return score(docs, model).select(
        "doc_id", (split_of("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    model = train(docs, labels.where(split_of("doc_id") != 2))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def keep(it):
        m = broadcast.value
        lookup = _Lookup(m.ids)
        for batch in it:
            texts = batch.column("text")
            for first, last in pieces(texts):
                part = batch.slice(first, last - first)
                text, feature = lookup.found(part.column("text"))
                z = np.bincount(text, m.weights[feature], part.num_rows) + m.intercept
                yield part.filter(pa.array(z < np.log(THRESHOLD / (1 - THRESHOLD))))

    return docs.mapInArrow(keep, docs.schema)
