"""Operator 9, quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams: one counted over every document
(raw), one over trusted documents (target).  A document's score is the mean
over its n-grams of log(target probability / raw probability); its verdict is
the comparison of that score with one threshold, for every document alike.

The raw counts cover the whole corpus: each task counts its rows into a fixed
table of BUCKETS numbers and one aggregation adds these up.  The target covers
every document labelled quality 1: their ids are joined to the documents, never
collected.  The threshold is SLACK below the TAIL quantile of the trusted
documents' own scores (or below 0), so clean text passes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import bounded_broadcast, cut_lineage
from .frames import pieces, read_table, take_columns, text_bytes, with_plain_names
from .words import IS_WORD, U, mix, span_hashes, windows, word_spans

BUCKETS = 1 << 16
#: Widths of the byte n-grams.
WIDTHS = (2, 4)
#: Scores are whole multiples of 1 / SCORE_UNIT; a rank is found in steps of STEPS.
SCORE_UNIT = 10**9
STEPS = (10**6, 10**3, 1)
TAIL = 0.002
#: Nats an n-gram below the trusted documents' tail that still pass.
SLACK = 0.25
#: Added to each bucket's count.
SMOOTHING = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def ngram_buckets(buf: np.ndarray, offsets: np.ndarray):
    """(buckets, how many each text has) of all n-grams inside a text."""
    out, n, word = [], len(buf), buf.astype(np.uint32)
    last = np.repeat(offsets[1:], np.diff(offsets))
    counts = np.zeros(len(offsets) - 1, np.int64)
    for width in WIDTHS:
        if n < width:
            continue
        h = np.zeros(n - width + 1, np.uint32)
        for j in range(width):
            h = h * np.uint32(257) + word[j:n - width + 1 + j]
        h = (h + np.uint32(width)) * np.uint32(2654435769)
        inside = np.arange(len(h)) + width <= last[:len(h)]
        out.append((h >> np.uint32(16), inside))
        counts += np.maximum(np.diff(offsets) - width + 1, 0)
    return out, counts


def ngram_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for h, inside in ngram_buckets(buf, offsets)[0]:
        total += np.bincount(h[inside], minlength=BUCKETS)
    return total


def ngram_scores(buf: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams; 0 for a text without any."""
    grams, counts = ngram_buckets(buf, offsets)
    sums = np.zeros(len(offsets) - 1)
    for h, inside in grams:
        running = np.concatenate([[0.0], np.cumsum(np.where(inside, ratio[h], 0.0))])
        at = np.minimum(offsets, len(h))
        sums += running[at[1:]] - running[at[:-1]]
    return np.round(sums / np.maximum(counts, 1), 9)


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and ``trusted``: whether the document is labelled quality 1.
    The ids are broadcast only where they are measured to be few; null ids are
    never trusted."""
    ids = (take_columns(labels, "doc_id", "quality")
           .filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    return (take_columns(docs, "doc_id", "text")
            .join(bounded_broadcast(ids.withColumn("_trusted", F.lit(True))), "doc_id", "left")
            .select("doc_id", "text", F.col("_trusted").isNotNull().alias("trusted")))


def fit_ratio(docs: DataFrame) -> np.ndarray:
    """log(target / raw) of every bucket, ``docs`` having ``trusted``.  All zero
    (every text scores 0, none is rejected) where there is no document or no
    trusted one."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in pieces(batches, "text"):
            buf, offsets = text_bytes(b.column("text"))
            raw += ngram_counts(buf, offsets)
            for i in np.flatnonzero(b.column("trusted").to_numpy(zero_copy_only=False)):
                target += ngram_counts(buf[offsets[i]:offsets[i + 1]],
                                       offsets[i:i + 2] - offsets[i])
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])],
                ["bucket", "raw", "target"])

    rows = (docs.select("text", "trusted")
            .mapInArrow(count, "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
            .toPandas())  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    ratio = (np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS))
             - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)))
    # whole multiples of 2^-20: sums of any order are then exact, so equal
    # texts score the same wherever they lie in a batch
    return np.round(ratio * 2**20) / 2**20


def nth_smallest(keys: DataFrame, n: int) -> int:
    """The value at place ``n`` (from 0) of the long column ``key``, found in
    STEPS: each counts the values by their leading part, among those that share
    the part found before, so a step reads at most a few thousand counts."""
    part = keys
    for step in STEPS:
        counts = sorted(part.groupBy(F.floor(F.col("key") / F.lit(step)).alias("at")).count().collect())
        for at, many in counts:
            if n < many:
                break
            n -= many
        part = part.where(F.floor(F.col("key") / F.lit(step)) == at)
    return at


def fit_threshold(docs: DataFrame, ratio: np.ndarray) -> float:
    """SLACK below the TAIL quantile (exact, interpolated) of the trusted
    documents' scores, or below 0 where that is less; minus infinity without
    trusted documents."""

    def score(batches):
        for p in pieces(batches, "text"):
            scores = ngram_scores(*text_bytes(p.column("text")), ratio)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.rint(scores * SCORE_UNIT).astype(np.int64))], ["key"])

    # one number a trusted document
    keys = cut_lineage(docs.where("trusted").select("text").mapInArrow(score, "key long"))
    n = keys.count()
    if not n:
        return float("-inf")
    place = (n - 1) * TAIL
    low = int(place)
    found = nth_smallest(keys, low) / SCORE_UNIT
    if place > low:
        above = nth_smallest(keys, low + 1) / SCORE_UNIT
        found = found if above == found else (low + 1 - place) * found + (place - low) * above
    return min(found, 0.0) - SLACK


def repeat_word_counts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text inside 3-word windows found twice or more in it."""
    text = np.repeat(np.arange(len(counts)), counts)
    w, first = windows(h, counts, 3)
    own = mix(w + text[first].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(h), bool)
    for j in range(3):
        cover[first[again] + j] = True
    return np.bincount(text[cover], minlength=len(counts))


def repeated_lines(text: str) -> int:
    """Lines holding a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items()
               if n > 1 and line.strip(" \t\n\x0b\x0c\r"))


def base_features(column: pa.Array) -> dict[str, np.ndarray]:
    buf, offsets = text_bytes(column)
    starts, ends, counts = word_spans(buf, offsets)
    h = span_hashes(buf, starts, ends)
    chars = np.concatenate([[0], np.cumsum(IS_WORD[buf] & ((buf & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[buf])])
    repeats = repeat_word_counts(h, counts)
    return {"n_words": counts,
            "word_chars": np.diff(chars[offsets]),
            "n_symbols": np.diff(symbols[offsets]),
            "n_dup_lines": np.array([repeated_lines(t) if t else 0
                                     for t in column.to_pylist()], np.int64),
            "n_repeat_words": repeats,
            "base_failed": (counts < 50) | (100 * repeats > 50 * counts)}


def verdicts(column: pa.Array, ratio: np.ndarray, threshold: float):
    """(base figures, scores, kept) of a column of texts."""
    base = base_features(column)
    score = ngram_scores(*text_bytes(column), ratio)
    return base, score, ~base["base_failed"] & (score >= threshold)


def score_quality(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    """One row per row of ``docs``: the base figures, ``score`` and ``kept``.

    A null text counts as empty: no words, score 0, base failed."""

    def rows(batches):
        for b in pieces(batches, "text"):
            base, score, kept = verdicts(b.column("text"), ratio, threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(v) for v in base.values()]
                + [pa.array(kept), pa.array(score)], ["doc_id", *base, "kept", "score"])

    return take_columns(docs, "doc_id", "text").mapInArrow(
        rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, base_failed boolean, kept boolean, score double")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(ratio, threshold) from all documents and all that are trusted."""
    own = with_trust(docs, labels)
    ratio = fit_ratio(own)
    return ratio, fit_threshold(own, ratio)


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they are."""
    ratio, threshold = fit(docs, labels)

    def rows(batches):
        for b in pieces(batches, "text"):
            _, _, kept = verdicts(b.column("text"), ratio, threshold)
            yield b.filter(pa.array(kept))

    plain, restored = with_plain_names(docs, "text")
    return restored(plain.mapInArrow(rows, plain.schema))


def fitted_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``docs`` and ``labels``, then score every document.  Repeated
    rows count and are scored each; an empty table gives an empty one."""
    return score_quality(docs, *fit(docs, labels))


def quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's base figures and verdict."""
    return fitted_quality(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                          read_table(spark, sf_dir, "labels", "doc_id", "quality"))
