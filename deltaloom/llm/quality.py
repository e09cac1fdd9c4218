"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

A document's features are its hashed words (log counts, unit length) and one bucket for each statistic: lengths, lines,
shares of letters, digits and marks, repetition. The score is a logistic function of weights plus all
pairwise interactions of low rank, summed in linear time as half of (sum of v x) squared minus sum of (v x) squared.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import SpanHasher, documents, fold_case, share, small_batches, text_chunks, training_part, word_spans

#: Bounds of the training sample: labelled rows, those with the smallest crc32 of the id, and whole texts until so many
#: characters are reached.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 32_000_000
BITS = 17
RANK = 8
BUCKETS = 8
THRESHOLD = 0.3
_GROUPS = (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"|", b"!", b"#$%&*@~^", b".,;:?", b"\"'()[]{}<>", b"=+-_/\\", bytes(range(128, 256)))
_STATS = len(_GROUPS) + 11


class Extractor:
    """Hashed words (document, bucket, value) and statistics of some texts."""

    def __init__(self):
        self.hasher = SpanHasher()
        self.member = np.zeros((len(_GROUPS), 256), dtype=np.int32)
        for row, group in zip(self.member, _GROUPS):
            row[list(group)] = 1

    def __call__(self, data: np.ndarray, bounds: np.ndarray):
        docs = len(bounds) - 1
        starts, ends, per_doc = word_spans(data, bounds)
        folded = fold_case(data)
        hashes = self.hasher(folded, starts, ends)
        owner = np.repeat(np.arange(docs), per_doc)
        key, count = np.unique(owner << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        doc, bucket = key >> BITS, key & ((1 << BITS) - 1)
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=docs))
        value = value / norm[doc]
        distinct = np.bincount(doc, minlength=docs)
        top = np.zeros(docs)
        np.maximum.at(top, doc, count)
        words, size = np.maximum(per_doc, 1), np.maximum(np.diff(bounds), 1)
        sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])
        stats = [sums(row[data]) / size for row in self.member]
        same = np.zeros(len(hashes))
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner, weights=same, minlength=docs) / words
        length = np.bincount(owner, weights=ends - starts, minlength=docs) / words
        cut = np.unique(np.concatenate((bounds, np.flatnonzero(data == 10) + 1)))
        line_starts, line_ends = cut[:-1], cut[1:]
        line_owner = np.searchsorted(bounds, line_starts, side="right") - 1
        lines = np.bincount(line_owner, minlength=docs)
        both = np.unique(mixed := line_owner.astype(np.uint64) << np.uint64(44) | (self.hasher(folded, line_starts, line_ends) >> np.uint64(20)))
        fresh = np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=docs) if len(mixed) else np.zeros(docs)
        full_stop = sums(np.isin(data, (46, 33, 63)))
        stats += [repeats, length, distinct / words, top / words, np.log1p(size), np.log1p(per_doc), np.log1p(lines), size / np.maximum(lines, 1), fresh / np.maximum(lines, 1), full_stop / words, per_doc == 0]
        return doc, bucket, value, np.stack(stats, axis=1).astype(np.float64)


class Machine:
    """Weights of the factorisation machine; features are word buckets and, after them, buckets of statistics."""

    def __init__(self, edges: np.ndarray, seed: int = 11):
        self.edges = edges
        size = (1 << BITS) + _STATS * (BUCKETS + 1)
        self.bias = 0.0
        self.w = np.zeros(size, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, RANK)).astype(np.float32)

    def features(self, doc, bucket, value, stats):
        """One list of (document, feature, value): words and statistics."""
        columns = [np.searchsorted(self.edges[k], stats[:, k], side="right") + k * (BUCKETS + 1) for k in range(stats.shape[1])]
        extra = np.stack(columns, axis=1) + (1 << BITS)
        rows = np.repeat(np.arange(len(stats)), stats.shape[1])
        return np.concatenate((doc, rows)), np.concatenate((bucket, extra.ravel())), np.concatenate((value, np.full(len(rows), stats.shape[1] ** -0.5)))

    def raw(self, doc, feature, value, docs: int):
        """(score before the logistic function, sum of v x) of each document."""
        out = self.bias + np.bincount(doc, weights=self.w[feature] * value, minlength=docs)
        sums = np.empty((docs, RANK))
        for k in range(RANK):
            part = self.v[feature, k] * value
            sums[:, k] = np.bincount(doc, weights=part, minlength=docs)
            out += 0.5 * (sums[:, k] ** 2 - np.bincount(doc, weights=part**2, minlength=docs))
        return out, sums

    def fit(self, doc, feature, value, labels, epochs: int = 60, rate: float = 0.15, decay: float = 1e-4):
        """Adagrad over the whole sample; both classes weigh alike in the first half, as they are in the second."""
        docs = len(labels)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        ones = max(labels.mean(), 1e-6)
        balance = np.where(labels == 1, 0.5 / ones, 0.5 / max(1 - ones, 1e-6))
        for epoch in range(epochs):
            raw, sums = self.raw(doc, feature, value, docs)
            slope = (1 / (1 + np.exp(-raw)) - labels) / docs * (balance if 2 * epoch < epochs else 1.0)
            each = slope[doc] * value
            grad = np.bincount(feature, weights=each, minlength=len(self.w)) + decay * self.w / docs
            gw += grad**2
            for k in range(RANK):
                g = np.bincount(feature, weights=each * (sums[doc, k] - self.v[feature, k] * value), minlength=len(self.w)) + decay * self.v[:, k] / docs
                gv[:, k] += g**2
                self.v[:, k] -= 0.3 * rate * g / np.sqrt(gv[:, k])
            self.w -= rate * grad / np.sqrt(gw)
            gb += slope.sum() ** 2
            self.bias -= rate * slope.sum() / np.sqrt(gb)

    def scores(self, data: np.ndarray, bounds: np.ndarray, extractor: Extractor) -> np.ndarray:
        raw, _ = self.raw(*self.features(*extractor(data, bounds)), len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit_texts(texts: list[str], labels: list[int]) -> Machine:
    """A machine fitted on texts labelled 0 or 1."""
    doc, bucket, value, stats, base = [], [], [], [], 0
    extractor = Extractor()
    for first, last, data, bounds in text_chunks(pa.array(texts, pa.string())):
        d, b, v, s = extractor(data, bounds)
        doc.append(d + first), bucket.append(b), value.append(v), stats.append(s)
    if not stats:
        return Machine(np.zeros((_STATS, BUCKETS)))
    stats = np.concatenate(stats)
    machine = Machine(np.quantile(stats, np.linspace(0, 1, BUCKETS + 2)[1:-1], axis=0).T.copy())
    machine.fit(*machine.features(np.concatenate(doc), np.concatenate(bucket), np.concatenate(value), stats), np.array(labels, dtype=np.float64))
    return machine


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE_DOCS) -> Machine:
    """Fit on ``bound`` labelled rows at most. Null labels teach nothing; a null text counts as empty."""
    order = F.crc32(F.col(id_col).cast("string").cast("binary"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y_"))
    top = min(2**32, int(1.2 * (bound + 50) / max(known.count(), 1) * 2**32))
    rows = docs.where(order < top).select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t_")).join(known.where(order < top), id_col)
    rows = rows.select(order.alias("o"), F.col(id_col).alias("i"), "t_", "y_", F.length("t_").alias("n"))
    by_rank = lambda r: (r.o, r.i, r.n, r.y_)
    few = sorted(rows.drop("t_").collect(), key=by_rank)[:bound]
    keep = max(1, int(np.searchsorted(np.cumsum([r.n for r in few]), SAMPLE_CHARS, side="right"))) if few else 0
    found = sorted(rows.where(F.col("o") <= few[keep - 1].o).collect(), key=by_rank)[:keep] if keep else []
    return fit_texts([r.t_ for r in found], [r.y_ for r in found])


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score double): likelihood of label 1 of every whole text.

    * Nulls and empty texts are scored like any other, a null text as an empty one; a null id stays.
    * Very long texts are scored whole. Ties: equal texts have equal scores, and a score of the threshold counts as label 1.
    * Repeated rows: a row for each input row. An empty table gives an empty result.
    * Other columns are not carried, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = share(docs.sparkSession, machine)  # of fixed size

    def run(batches):
        model, extractor = pickle.loads(shared.value), Extractor()
        for batch in batches:
            scores = [model.scores(data, bounds, extractor) for _, _, data, bounds in text_chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; those whose crc32 modulo 5 is 0 are held out."""
    small_batches(spark)
    held = training_part(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held)
    found = classify(documents(spark, sf_dir), train(documents(spark, sf_dir), labels))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
