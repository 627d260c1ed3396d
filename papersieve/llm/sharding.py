"""Operator 10, sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes and no global sort: rows lie in P
blocks; the number of rows that block b sends to shard s is drawn from the
exact law it has under a uniform permutation (a multivariate hypergeometric
matrix with the blocks' and shards' sizes as margins); each block permutes its
rows and deals them out by its matrix row; each shard permutes again.

Only the P block sizes and the P x shards matrix pass through the driver; rows
are moved by DataFrame operations alone.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import cut_lineage
from .frames import read_table

#: Blocks of the matrix: this many, and one more for each ROWS_PER_BLOCK rows,
#: so a block's window stays small and the matrix far smaller than the rows.
LEAST_BLOCKS = 64
ROWS_PER_BLOCK = 1_000_000
#: Copies of one row that one task writes out.
AT_ONCE = 65_536


def draw_hypergeometric(rng: random.Random, good: int, bad: int, take: int) -> int:
    """How many of ``take`` draws without replacement are good.

    One sampler for all sizes: the law's ratios outward from its mode, over
    all values within 12 standard deviations (all of them where fewer; what
    lies outside weighs less than a double can hold), then the inverse."""
    low, high = max(0, take - bad), min(good, take)
    if low >= high:
        return low
    total = good + bad
    mode = min(max((take + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(take * (good / total) * (bad / total)
                       * max(total - take, 0) / max(total - 1, 1))
    reach = int(12 * spread) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(mode, b, dtype=float)
    up = np.cumprod((good - k) * (take - k) / ((k + 1) * (bad - take + k + 1)))
    k = np.arange(mode, a, -1, dtype=float)
    down = np.cumprod(k * (bad - take + k) / ((good - k + 1) * (take - k + 1)))
    weight = np.concatenate([down[::-1], [1.0], up]).cumsum()
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each block to each shard; margins are met exactly."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in blocks:
        rest, take, row = sum(left), size, []
        for s, room in enumerate(left):
            got = take if s == len(left) - 1 else draw_hypergeometric(rng, room, rest - room, take)
            row.append(got)
            rest -= room
            take -= got
        left = [room - got for room, got in zip(left, row, strict=True)]
        out.append(row)
    return out


def copies_apart(rows: DataFrame, names: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """``rows`` with ``_h`` renewed by each row's number among its equals, so
    that copies of one row fall into all blocks.

    Equal rows are counted map-side and written out again from their count;
    a count above ``at_once`` is first dealt over tasks."""
    counted = rows.groupBy("_h", *names).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {at_once}"))))
    few = F.col("_n") <= at_once
    dealt = counted.filter(few).unionByName(counted.filter(~few).repartition("_h", "_run"))
    first = F.col("_run") * at_once
    copy = F.explode(F.sequence(first + 1, F.least(first + at_once, F.col("_n"))))
    return (dealt.select("_h", *names, copy.alias("_copy"))
            .select(F.xxhash64("_h", "_copy").alias("_h"), *names))


def shard_rows(df: DataFrame, n_shards: int = 40, seed: int = 10) -> DataFrame:
    """``df`` with columns ``shard`` (0 to n_shards - 1) and ``slot`` (gapless
    from 0 inside its shard): a uniform shuffle whose shard sizes differ by at
    most one.

    Reruns agree: hashes of all columns decide, not partitions or row order.
    Rows equal in every column are interchangeable and spread like any other
    rows, however many; a null is a value like any
    other; an empty table gives an empty one; columns named ``shard`` or
    ``slot`` before are replaced."""
    df = df.drop("shard", "slot")
    names = df.columns
    inner = [f"_s{i}" for i in range(len(names))]
    rows = df.toDF(*inner)
    rows = cut_lineage(copies_apart(rows.withColumn("_h", F.xxhash64(F.lit(seed), *inner)), inner))
    total = rows.count()
    n_blocks = LEAST_BLOCKS + total // ROWS_PER_BLOCK
    block = F.pmod(F.col("_h"), F.lit(n_blocks)).cast("int")
    rows = rows.withColumn("_block", block)
    sizes = [0] * n_blocks
    for r in rows.groupBy("_block").count().collect():  # n_blocks rows at most
        sizes[r[0]] = r[1]
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(sizes, shards, seed)
    deals = [{"_block": b, "_ends": np.cumsum(row).tolist()} for b, row in enumerate(matrix)]
    deal = (df.sparkSession.range(1)
            .select(F.inline(F.from_json(F.lit(json.dumps(deals)),
                                         "array<struct<_block:int,_ends:array<bigint>>>"))))

    def order(salt):
        return [F.xxhash64(F.lit(seed + salt), F.col("_h")), *inner]

    local = Window.partitionBy("_block").orderBy(*order(1))
    # the deal has n_blocks rows of n_shards numbers: bounded whatever the row width
    dealt = (rows.withColumn("_at", F.row_number().over(local) - 1)
             .join(F.broadcast(deal), "_block")
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))))
             .withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_h")),
                                         F.lit(n_blocks)).cast("int"))
             .select("shard", "_part", "_h", *inner))
    # the second permutation, in n_blocks parts of each shard, laid end to end
    parts = dealt.groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = parts.select("shard", "_part",
                          F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_part").orderBy(*order(3))
    return (dealt.withColumn("_at", F.row_number().over(again) - 1)
            .join(F.broadcast(starts), ["shard", "_part"])  # n_shards x n_blocks rows
            .select(*[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)],
                    F.col("shard").cast("int").alias("shard"),
                    (F.col("_start") + F.col("_at")).cast("long").alias("slot")))


def sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 39, law ``rows``."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    return (shard_rows(digest)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
