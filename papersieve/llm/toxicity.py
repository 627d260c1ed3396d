"""Operator 4, toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed words is trained from confirmed toxic
documents (P) and unlabelled ones (U) on the risk
    prior * R_P(toxic) + max(0, R_U(clean) - prior * R_P(clean)),
which is the risk of a labelled sample whose share of toxic text is the class
prior; where the second term falls below 0, its gradient is walked back.  The
fit reads a bounded sample of distinct texts (POSITIVES, UNLABELLED: smallest
hash of the text), so copies count once; every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pieces, read_table, take_columns, text_bytes
from .words import U, span_hashes, word_spans

#: Most confirmed toxic and most unlabelled texts in the fit.
POSITIVES = 10_000
UNLABELLED = 20_000
#: Hash buckets of words.
BUCKET_BITS = 20
#: A feature is a word that so many toxic documents of the sample hold at
#: least, and more of them than of the unlabelled by so many standard errors.
LEAST_TOXIC = 5
LEAST_LIFT = 6.0
STEPS = 400
RATE = 0.05
RIDGE = 1e-4

#: Bytes of a word here: ASCII letters and digits, and all of other scripts.
LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct lower-cased words of each text."""
    buf, offsets = text_bytes(column)
    starts, ends, counts = word_spans(buf, offsets, LETTER)
    bucket = span_hashes(buf, starts, ends, lower=True) >> U(64 - BUCKET_BITS)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    both = np.unique(text << U(BUCKET_BITS) | bucket)
    return (both >> U(BUCKET_BITS)).astype(np.int64), (both & U((1 << BUCKET_BITS) - 1)).astype(np.int64)


class Words:
    """0/1 rows of words as a sparse matrix: ``x @ w`` and ``g @ x``, in runs of
    entries so that no array besides the indices is large."""

    __array_ufunc__ = None
    RUN = 1 << 20

    def __init__(self, group: list[np.ndarray], keep: np.ndarray):
        own = [np.searchsorted(keep, b[np.isin(b, keep)]).astype(np.int32) for b in group]
        self.shape = len(group), len(keep)
        self.row = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
        self.at = np.concatenate([*own, np.zeros(0, np.int32)])

    def __len__(self):
        return self.shape[0]

    def _sums(self, to, of, values, n):
        out = np.zeros(n)
        for i in range(0, len(to), self.RUN):
            part = slice(i, i + self.RUN)
            out += np.bincount(to[part], values[of[part]], minlength=n)
        return out

    def __matmul__(self, w):
        return self._sums(self.row, self.at, w, self.shape[0])

    def __rmatmul__(self, g):
        return self._sums(self.at, self.row, g, self.shape[1])


def nnpu_fit(xp: np.ndarray | Words, xu: np.ndarray | Words, prior: float, steps: int = STEPS,
             rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss."""
    w, b = np.zeros(xp.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def logits(x):
        return x @ w + b

    def grad(x, g):
        return np.append(g @ x, g.sum())

    for t in range(1, steps + 1):
        zp, zu = logits(xp), logits(xu)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # the loss of calling a text clean is log(1 + e^z)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_clean = grad(xu, su / len(su)) - prior * grad(xp, sp / len(sp))
        g = (prior * grad(xp, (sp - 1) / len(sp)) + g_clean) if clean >= 0 else -g_clean
        g[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def sample_texts(rows: DataFrame, most: int) -> list[tuple[int, int]]:
    """(text key, its least id) of the ``most`` distinct texts of smallest hash."""
    return [tuple(r) for r in
            rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
            .orderBy(F.xxhash64(F.lit(4), "key"), "key").limit(most).collect()]


def sample_words(docs: DataFrame, texts: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Distinct word buckets of the sampled texts by key, each from one row."""
    ids = np.unique(np.array([i for _, i in texts], np.int64))
    keys = np.unique(np.array([k for k, _ in texts], np.int64))

    def rows(batches):
        for b in batches:
            own = b.filter(pa.array(np.isin(np.array(b.column("doc_id")), ids)
                                    & np.isin(np.array(b.column("key")), keys)))
            for p in pieces([own], "text"):
                text, bucket = word_buckets(p.column("text"))
                cut = np.searchsorted(text, np.arange(p.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [p.column("key"), pa.array([bucket[cut[i]:cut[i + 1]].astype(np.int32).tobytes()
                                                for i in range(p.num_rows)], pa.binary())],
                    ["key", "words"])

    # repeated rows have one id and text: one of them comes to the driver
    table = docs.mapInArrow(rows, "key long, words binary").dropDuplicates(["key"]).toArrow()
    return {k: np.frombuffer(x, np.int32) for k, x in
            zip(table["key"].to_pylist(), table["words"].to_pylist(), strict=True)}


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES,
                 unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """(weight of every bucket, bias), learned outside fold 0 only.  Without a
    toxic training document the score is the class prior (0 without labels)."""
    docs = take_columns(docs, "doc_id", "text").filter("doc_id IS NOT NULL").filter(fold() != 0) \
        .withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = take_columns(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL") \
        .filter(fold() != 0)
    # copies of a text count once, in the prior as in the sample
    said = (docs.select("doc_id", "key").join(known, "doc_id").groupBy("key")
            .agg(F.avg(F.col("toxic").cast("double")).alias("toxic"), F.min(F.when(
                F.col("toxic") == 1, F.col("doc_id"))).alias("doc_id")))
    prior = said.agg(F.avg("toxic")).first()[0]
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = sample_texts(said.filter("doc_id IS NOT NULL"), positives)
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    if not len(toxic):
        return weight, float(np.log(prior / (1 - prior)))
    other = sample_texts(docs, unlabelled)
    words = sample_words(docs, toxic + other)
    groups = [[words[k] for k, _ in sorted(chosen)] for chosen in (toxic, other)]
    df = [np.bincount(np.concatenate(g), minlength=1 << BUCKET_BITS) for g in groups]
    rate = [(d + 0.5) / (len(g) + 1) for d, g in zip(df, groups, strict=True)]
    lift = (rate[0] - rate[1]) / np.sqrt(rate[1] * (1 - np.minimum(rate[1], 0.999)) / len(groups[0]))
    lift[df[0] < LEAST_TOXIC] = 0
    keep = np.flatnonzero(lift > LEAST_LIFT).astype(np.int32)
    if not len(keep):
        return weight, float(np.log(prior / (1 - prior)))

    w, b = nnpu_fit(Words(groups[0], keep), Words(groups[1], keep), prior)
    weight[keep] = w
    return weight, float(b)


def score_toxicity(docs: DataFrame, weight: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score, predicted of every row; a null or empty text has the
    bias alone; repeated rows are scored each."""

    def rows(batches):
        for b in pieces(batches, "text"):
            text, bucket = word_buckets(b.column("text"))
            sums = np.bincount(text, weight[bucket].astype(float), minlength=b.num_rows)
            score = 1 / (1 + np.exp(-np.clip(np.round(sums, 9) + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return take_columns(docs, "doc_id", "text").mapInArrow(
        rows, "doc_id long, score double, predicted int")


def toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's score, learned outside fold 0."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    weight, bias = fit_toxicity(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, weight, bias).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
