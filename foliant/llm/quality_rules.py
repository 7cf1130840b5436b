"""Quality rules: weak supervision instead of an all-must-pass filter.

Each rule votes good (1) or bad (0) on a document or abstains (-1). Expectation-maximisation
over the vote patterns of all documents estimates each rule's accuracy on good and on bad
documents and the share of good ones; a document is kept if its posterior probability of
being good reaches the threshold. At most 3**rules patterns exist, so counting them by
pattern is all that the estimation gathers, whatever the number of documents.

Defined cases: a null or empty text has no words, all its counts are 0 and its base check
fails; repeated rows and ties each get the same verdict; an empty table gives an empty
result; extra columns pass through untouched, and ``quality_rules`` replaces columns of
the names it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import text as X
from foliant.llm.columns import Apart
from foliant.llm.scratch import small_batches, tidy

_SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= (b & 0xDF) <= 90 for b in range(256)])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_marked_words", "n_bang_words"]
RULES = ["length", "symbols", "marked_words", "duplicate_lines", "repetition", "shouting", "exclaiming", "word_length"]
MIN_WORDS = 50


def chunk_counts(c: X.Chunk) -> dict[str, np.ndarray]:
    """The counts of every text of a chunk."""
    word_byte = X.BLANK[c.data]
    w = X.spans(word_byte, c.offsets)
    hashes = X.hasher(c.data)
    out = {"n_words": w.counts}
    out["word_chars"] = X.counts(word_byte & ((c.data & 0xC0) != 0x80), c.offsets)
    symbol = _SYMBOLS[c.data]
    out["n_symbols"] = X.counts(symbol, c.offsets)

    lines = X.spans(c.data != 10, c.offsets)
    # No word crosses the end of a line.
    wordy = np.zeros(len(lines.start), dtype=bool)
    wordy[np.searchsorted(lines.start, w.start, side="right") - 1] = True
    owner = lines.text[wordy]
    h = hashes(lines.start[wordy], lines.end[wordy])
    _, once = X.distinct(h, owner)
    out["n_lines"] = np.bincount(owner, minlength=c.n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(once, minlength=c.n)

    covered = np.zeros(len(w.start), dtype=bool)
    if len(w.start) >= 3:
        wh = hashes(w.start, w.end)
        at = np.flatnonzero(w.text[:-2] == w.text[2:])
        base = np.uint64(0x9E3779B97F4A7C15)
        tri = X.mix((wh[at] * base + wh[at + 1]) * base + wh[at + 2])
        order = X.group_sort(tri, w.text[at])
        t, o = tri[order], w.text[at][order]
        same = (t[1:] == t[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(t), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for j in range(3):
            covered[hit + j] = True
    out["n_repeat_words"] = X.sums(covered.astype(np.int64), w.bounds)

    out["n_upper"] = X.counts(_UPPER[c.data], c.offsets)
    out["n_letters"] = X.counts(_LETTER[c.data], c.offsets)
    n_sym = np.zeros(len(c.data) + 1, dtype=np.int32)
    np.cumsum(symbol, dtype=np.int32, out=n_sym[1:])
    out["n_marked_words"] = X.sums((n_sym[w.end] > n_sym[w.start]).astype(np.int64), w.bounds)
    out["n_bang_words"] = X.sums((c.data[w.end - 1] == ord("!")).astype(np.int64), w.bounds)
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _vote(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 1, -1)).astype(np.int8)


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document, one column per rule: 1 good, 0 bad, -1 abstains."""
    n = c["n_words"]
    symbols, marked = _ratio(c["n_symbols"], n), _ratio(c["n_marked_words"], n)
    dup, rep = _ratio(c["n_dup_lines"], c["n_lines"]), _ratio(c["n_repeat_words"], n)
    upper, bang, mean = _ratio(c["n_upper"], c["n_letters"]), _ratio(c["n_bang_words"], n), _ratio(c["word_chars"], n)
    never = np.zeros(len(n), dtype=bool)
    out = [
        _vote(n, n >= 80, n < MIN_WORDS),
        _vote(symbols, never, symbols > 0.05),
        _vote(marked, never, marked > 0.04),
        _vote(dup, never, dup > 0.4),
        _vote(rep, rep <= 0.1, rep > 0.4),
        _vote(upper, never, upper > 0.25),
        _vote(bang, never, bang > 0.05),
        _vote(mean, (mean >= 3) & (mean <= 8), (mean < 2) | (mean > 15)),
    ]
    silent = n == 0
    return np.where(silent[:, None], np.int8(0), np.stack(out, axis=1))


def pattern_code(v: np.ndarray) -> np.ndarray:
    """A number for each row of votes, in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def decode(codes: np.ndarray, n_rules: int) -> np.ndarray:
    return (np.asarray(codes, dtype=np.int64)[:, None] // 3 ** np.arange(n_rules)) % 3 - 1


@dataclass
class LabelModel:
    """prior: share of good documents; on_good, on_bad: chances of each rule's abstaining, bad and good vote (columns 0 to 2)."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """Of each rule: how often it is right when it votes."""
        right = self.prior * self.on_good[:, 2] + (1 - self.prior) * self.on_bad[:, 1]
        return right / np.maximum(right + self.prior * self.on_good[:, 1] + (1 - self.prior) * self.on_bad[:, 2], 1e-300)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        rules = np.arange(v.shape[1])
        z = np.log(self.prior) - np.log1p(-self.prior) + (np.log(self.on_good) - np.log(self.on_bad))[rules, v.astype(int) + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(v: np.ndarray, weight: np.ndarray, rounds: int = 200, smooth: float = 2.0) -> LabelModel:
    """Expectation-maximisation from rules that are right nine times in ten.

    An abstention counts as evidence too, as a rule may abstain more often on one kind.
    ``smooth`` pseudo-documents with the starting chances keep estimates inside (0, 1);
    without documents the starting values stay.
    """
    k = v.shape[1]
    total = max(weight.sum(), 1e-300)
    marginal = np.stack([((v == x) * weight[:, None]).sum(axis=0) for x in (-1, 0, 1)], axis=1) / total + 1e-3
    start = {True: marginal * [1.0, 0.1, 0.9], False: marginal * [1.0, 0.9, 0.1]}
    start = {y: t / t.sum(axis=1, keepdims=True) for y, t in start.items()}
    model = LabelModel(0.8, start[True], start[False])
    if weight.sum() == 0:
        return model
    seen = np.stack([v == x for x in (-1, 0, 1)], axis=2).reshape(len(v), -1).astype(float)
    for _ in range(rounds):
        q = model.posterior(v)
        good, bad = weight * q, weight * (1 - q)
        on_good = ((good @ seen).reshape(k, 3) + smooth * start[True]) / (good.sum() + smooth)
        on_bad = ((bad @ seen).reshape(k, 3) + smooth * start[False]) / (bad.sum() + smooth)
        new = LabelModel((good.sum() + smooth * 0.8) / (weight.sum() + smooth), on_good, on_bad)
        moved = max(abs(new.prior - model.prior), np.abs(new.on_good - model.on_good).max(), np.abs(new.on_bad - model.on_bad).max())
        model = new
        if moved < 1e-9:
            break
    return model


def _counts_table(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [chunk_counts(c) for c in X.chunks(texts)]
    if not parts:
        return {k: np.zeros(0, dtype=np.int64) for k in COUNTS + MORE}
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in COUNTS + MORE}


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = _counts_table(b.column(b.num_columns - 1))
        kept = {name: b.column(i) for i, name in enumerate(b.schema.names[:-1])}
        yield pa.RecordBatch.from_pydict(kept | {k: pa.array(c[k]) for k in COUNTS} | {"pattern": pa.array(pattern_code(votes(c)))})


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five base counts and the vote pattern of every document; only these two columns are read."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", pattern bigint"
    return docs.select(id_col, text_col).mapInArrow(_measure, schema)


def fit_patterns(measured_docs: DataFrame) -> LabelModel:
    """The label model from the counts of vote patterns over all documents."""
    rows = measured_docs.groupBy("pattern").count().collect()  # at most 3**8 rows
    codes = np.array([r["pattern"] for r in rows], dtype=np.int64)
    return fit(decode(codes, len(RULES)), np.array([r["count"] for r in rows], dtype=float))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _posteriors(model: LabelModel):
    def score(patterns: pd.Series) -> pd.Series:
        codes, back = np.unique(patterns.to_numpy(), return_inverse=True)
        return pd.Series(model.posterior(decode(codes, len(RULES)))[back])

    return F.pandas_udf(score, "double")


def judged(measured_docs: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, posterior and kept, and drops the pattern."""
    return (
        measured_docs.withColumn("base_failed", base_failed())
        .withColumn("posterior", _posteriors(model)("pattern"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .drop("pattern")
    )


def quality_rules(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with n_words, ..., posterior and kept added. Texts are read twice, and never shuffled."""
    model = fit_patterns(measured(docs.select(F.lit(0).alias("one"), text_col), "one", text_col))
    added = [*COUNTS, "pattern"]
    made = [*COUNTS, "base_failed", "posterior", "kept"]
    own = Apart(docs.drop(*[c for c in docs.columns if c in made]))
    rest = own.df
    at = own.names.index(text_col)

    @tidy
    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in X.chunks(b.column(at)):
                counts = chunk_counts(c)
                new = [pa.array(counts[k].astype(np.int64)) for k in COUNTS] + [pa.array(pattern_code(votes(counts)))]
                yield pa.RecordBatch.from_arrays([*b.slice(c.first, c.n).columns, *new], [*b.schema.names, *added])

    kinds = T.StructType([*rest.schema.fields, *(T.StructField(k, T.LongType()) for k in added)])
    return own.back(judged(rest.mapInArrow(widen, kinds), model, threshold), {c: F.col(c) for c in made})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = measured(docs)
    return judged(m, fit_patterns(m))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    own = Apart(docs)
    return own.back(quality_rules(own.df, own["text"]).filter("kept"))
