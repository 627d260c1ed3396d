"""Operator 5, mixing sources to target weights by the cube method.

A document of a source is taken floor(m) or floor(m) + 1 times, m being its
source's target over its source's size.  The fractional part of m is its
inclusion probability.  The cube method's flight phase moves these
probabilities through the null space of the balancing constraints (documents
and words of the source stay at their expected totals) until at most two of a
block are still fractional.  Blocks hold about BLOCK documents of one source;
what blocks leave open is gathered into new blocks, level by level, until one
block a source remains, where the small landing problem drops one constraint
after the other.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import bounded_broadcast, cut_lineage
from .frames import read_table, take_columns, with_plain_names

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No document is taken more often than this.
MOST = 2
BLOCK = 4096
NEAR = 1e-9


def flight(p: list[float], rows: list[tuple[float, float]], rng: random.Random,
           constraints: int = 2) -> list[float]:
    """Move ``p`` along null vectors of the constraints (columns of ``rows``:
    documents, words) until at most ``constraints`` entries are strictly
    between 0 and 1.  Expected values and constrained totals are kept."""
    p = list(p)
    held: list[int] = []
    waiting = iter([i for i, x in enumerate(p) if NEAR < x < 1 - NEAR])
    while True:
        while len(held) <= constraints and (i := next(waiting, None)) is not None:
            held.append(i)
        v = null_vector([rows[i] for i in held], constraints)
        if v is None:
            return p
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x
                 for i, x in zip(held, v, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x
                   for i, x in zip(held, v, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(held, v, strict=True):
            moved = p[i] + step * x
            p[i] = 0.0 if moved < NEAR else 1.0 if moved > 1 - NEAR else moved
        held = [i for i in held if 0 < p[i] < 1]


def null_vector(rows: list[tuple[float, float]], constraints: int) -> list[float] | None:
    """A vector u with sum(u * documents) = 0 (and sum(u * words) = 0 where two
    constraints hold), scaled to a largest entry of 1; None if there is none."""
    if constraints == 0:
        return [1.0] if rows else None
    for a in range(len(rows)):  # two proportional rows balance each other
        for b in range(a + 1, len(rows)):
            if (constraints == 1 or rows[a][0] * rows[b][1] == rows[b][0] * rows[a][1]):
                v = [0.0] * len(rows)
                # one constraint: the words (the documents where neither has any)
                at = 1 if rows[a][1] or rows[b][1] else 0
                v[a], v[b] = rows[b][at], -rows[a][at]
                if v[a] == 0 or v[b] == 0:
                    v[a if rows[a][at] == 0 else b], v[b if rows[a][at] == 0 else a] = 1.0, 0.0
                return scaled(v)
    if len(rows) < 3:
        return None
    (n1, z1), (n2, z2), (n3, z3) = rows
    return scaled([n2 * z3 - n3 * z2, n3 * z1 - n1 * z3, n1 * z2 - n2 * z1])


def scaled(v: list[float]) -> list[float]:
    most = max(map(abs, v))
    return [x / most for x in v]


def land(p: list[float], rows: list[tuple[float, float]], rng: random.Random) -> list[float]:
    """The flight with fewer and fewer constraints, words last, until each
    entry is 0 or 1."""
    for constraints in (2, 1, 0):
        p = flight(p, rows, rng, constraints)
    return p


def source_targets(units: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """_source, source_size, target, _m: one row per source.

    Targets share ``share`` of all words by weight, cap ``most`` times the
    source's size, the excess reshared until none is above: the level L with
    sum(min(most * size, L * weight)) = share * total, found by running sums
    over the sources in the order of cap / weight."""
    sizes = units.groupBy("_source").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size"))
    # windows over one row per source
    rank = Window.orderBy(F.col("_source").isNull(), "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          (F.row_number().over(rank) - 1) % len(WEIGHTS) + 1)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", F.col("_source").isNull(), "_source")
    before, onward = (by_ratio.rowsBetween(Window.unboundedPreceding, -1),
                      by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = (sizes.withColumn("_w", weight)
         .withColumn("_cap", (F.col("source_size") * most).cast("double"))
         .withColumn("_ratio", F.col("_cap") / F.col("_w"))
         .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("_full", F.col("_ratio") <= (
             F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(onward)))
    level = ((F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0))
              .over(everything))
             / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything))
    s = s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w")))
    return s.select("_source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.least(
                        F.col("target") / F.col("source_size"), F.lit(float(most))))
                    .otherwise(0.0).alias("_m"))


def mix_units(units: DataFrame, seed: int = 5) -> DataFrame:
    """``units`` (_key, _source, size, _n) with source_size, target and
    ``copies``, the times each of its rows is taken."""
    spark = units.sparkSession
    sources = cut_lineage(source_targets(units))
    n_sources = sources.count()

    def with_sources(df, side):
        return df.join(bounded_broadcast(side, known_rows=n_sources),
                       df["_source"].eqNullSafe(side["_source"])).drop(side["_source"])

    rows = with_sources(units, sources)
    rows = rows.withColumn("_p", F.col("_m") - F.floor("_m"))
    level, done = 0, []
    while True:
        open_rows = rows.filter((F.col("_p") > NEAR) & (F.col("_p") < 1 - NEAR))
        counts = open_rows.groupBy("_source").agg(
            F.ceil(F.count("*") / BLOCK).cast("long").alias("_blocks"))
        counts = cut_lineage(counts)
        most = counts.agg(F.max("_blocks")).first()[0] or 0
        last = most <= 1
        dealt = (with_sources(open_rows, counts)
                 .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + level), "_key"),
                                              F.col("_blocks"))).drop("_blocks"))
        moved = dealt.groupBy("_source", "_block").applyInPandas(
            _mover(seed, level, last), dealt.schema).drop("_block")
        closed = rows.filter((F.col("_p") <= NEAR) | (F.col("_p") >= 1 - NEAR))
        done.append(closed)
        if most == 0:
            break
        rows = cut_lineage(moved)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", (F.floor("_m") + F.round("_p")).cast("int")) \
              .drop("_m", "_p")


def _mover(seed: int, level: int, last: bool):
    def move(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_key", "size", "_n"], kind="stable")
        rng = random.Random(f"{seed} {level} {block['_source'].iloc[0]} {block['_block'].iloc[0]}")
        rows = list(zip(block["_n"].astype(float), (block["_n"] * block["size"]).astype(float),
                        strict=True))
        step = land if last else flight
        return block.assign(_p=step(block["_p"].tolist(), rows, rng))

    return move


def document_units(docs: DataFrame) -> DataFrame:
    """Rows equal in id, source and text are one unit of ``_n`` rows, decided
    together; its key is a hash of the three.  The id goes along as text:
    pandas would make numbers with nulls floating."""
    return (take_columns(docs, "doc_id", "source", "text")
            .select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("_source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
                    .alias("size"),
                    F.xxhash64("doc_id", "source", "text").alias("_key"))
            .groupBy("_id", "_source", "size", "_key").agg(F.count("*").alias("_n")))


def mix_documents(docs: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, _source, size, _key, _n, source_size, target, copies: one row per
    distinct (id, source, text).  A null text has size 0, a null source is a
    source of its own, last in order; an empty table gives an empty one."""
    kind = take_columns(docs, "doc_id").schema[0].dataType
    return (mix_units(cut_lineage(document_units(docs)), seed)
            .withColumn("doc_id", F.col("_id").cast(kind)).drop("_id"))


def taken_rows(docs: DataFrame, seed: int = 5) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns as
    they are."""
    docs, restored = with_plain_names(docs, "doc_id", "source", "text")
    units = mix_documents(docs, seed).filter("copies > 0").select(
        F.col("_key").alias("_unit"), F.col("doc_id").alias("_unit_id"), "copies")
    rows = docs.withColumn("_key", F.xxhash64("doc_id", "source", "text"))
    return restored(
            rows.join(units, (rows["_key"] == units["_unit"])
                      & rows["doc_id"].eqNullSafe(units["_unit_id"]))
            .withColumn("_time", F.explode(F.sequence(F.lit(1), "copies"))))


def mixed(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents, one row per document."""
    units = mix_documents(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return units.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.col("copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")
    ).drop("_i")
