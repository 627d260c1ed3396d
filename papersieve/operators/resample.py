"""Oversampling on feature patterns (M1 SMOTE, M2 SMOTEN, U2, M9).

Both work on the answer patterns of ``train.patterns`` (keys, features, n, w0,
w1), never on rows, and neither forms all pairs: neighbours are found by
:func:`neighbours.nearest_rows`.  ``values`` are the values that an answer is
encoded as (0 and 1; 0, 0.5 and 1 under ``unsure_half``); any other raises.

A minority row's k neighbours are minority ROWS: the other copies of its
own pattern first (distance 0), then other patterns by distance (ties by
pattern code).  SMOTEN's synthetic row is the per-feature mode of the k
neighbours (a tie takes the smallest value), so every row of a pattern yields
the same synthetic pattern; the N_majority - N_minority draws (uniform over
minority rows) are allocated to patterns exactly in expectation by largest
remainder: deterministic, partition-independent, reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import bounded_broadcast, cut_lineage
from ..constants import SMOTE_K, SMOTEN_K
from .neighbours import BINARY, digit, nearest_rows, pattern_code, squared_costs, value_of


def class_totals(pats: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows of each class, the minority class and draws needed."""
    t = pats.groupBy(*keys).agg(F.sum("w0").alias("N0"), F.sum("w1").alias("N1"))
    return (t.withColumn("minority", F.when(F.col("N1") <= F.col("N0"), 1).otherwise(0))
            .withColumn("n_min", F.least("N0", "N1"))
            .withColumn("n_new", F.abs(F.col("N0") - F.col("N1"))))


def vdm_table(pats: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """P(class 1 | feature = value) per key, feature, value."""
    u = pats.select(*keys, "w0", "w1", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
        for f in features])))
    return (u.groupBy(*keys, "feature", "value")
            .agg(F.sum("w0").alias("c0"), F.sum("w1").alias("c1"))
            .withColumn("p1", F.col("c1") / (F.col("c0") + F.col("c1"))))


def _smoten_inputs(pats: DataFrame, features: list[str], keys: list[str], values):
    """Class totals, minority patterns (keys, code, m, n_min) and each key's
    costs: per feature, the value difference of two categories squared,
    (|P1(a) - P1(b)| + |P0(a) - P0(b)|)^2; a category without rows, which no
    pattern has, is infinitely far."""
    tot = class_totals(pats, keys)
    vdm = vdm_table(pats, features, keys)
    shares = vdm.groupBy(*keys, "feature").agg(
        *[F.max(F.when(F.col("value") == F.lit(float(v)), F.col("p1"))).alias(f"_p{i}")
          for i, v in enumerate(values)])
    table = F.array(*[F.lit(0.0) if i == j else F.coalesce(
        F.pow(2.0 * F.abs(F.col(f"_p{i}") - F.col(f"_p{j}")), 2.0), F.lit(float("inf")))
        for i in range(len(values)) for j in range(len(values))])
    fpos = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    cost = (shares.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.element_at(fpos, F.col("feature")).alias("i"), table.alias("c")))).alias("_cs"))
        .select(*keys, F.transform("_cs", lambda x: x["c"]).alias("costs")))
    minp = (pats.join(tot, keys)
            .withColumn("m", F.when(F.col("minority") == 1, F.col("w1")).otherwise(F.col("w0")))
            .where(F.col("m") > 0)
            .groupBy(*keys, pattern_code(features, values).alias("code"))
            .agg(F.sum("m").alias("m"), F.first("n_min").alias("n_min")))
    return tot, cut_lineage(minp), cost


def vdm_neighbours(pats: DataFrame, features: list[str], k: int = SMOTEN_K,
                   values=BINARY) -> DataFrame:
    """Each minority pattern's k nearest minority rows under the value
    difference metric: a_code, b_code, dist, take (rows taken from pattern b)."""
    p = pats.withColumn("_k", F.lit(0))
    _tot, minp, cost = _smoten_inputs(p, features, ["_k"], values)
    return nearest_rows(minp, ["_k"], k, cost, values).drop("_k").withColumn(
        "take", F.col("take").cast("double"))


def smoten(pats: DataFrame, features: list[str], keys: list[str] | tuple = (),
           k: int = SMOTEN_K, values=BINARY) -> DataFrame:
    """M2: synthetic minority patterns with counts:
    keys, features, n, w0, w1, is_synthetic=true."""
    keys = list(keys)
    drop_key = not keys
    if drop_key:
        pats = pats.withColumn("_k", F.lit(0))
        keys = ["_k"]
    radix = len(values)
    tot, minp, cost = _smoten_inputs(pats, features, keys, values)
    nb = nearest_rows(minp, keys, k, cost, values)
    votes = nb.groupBy(*keys, "a_code").agg(
        *[F.sum(F.when(digit("b_code", i, radix) == c, F.col("take")).otherwise(0)).alias(f"v{i}_{c}")
          for i in range(len(features)) for c in range(radix)])
    syn_code = F.lit(0).cast("long")
    for i in range(len(features)):
        own = F.array(*[F.col(f"v{i}_{c}") for c in range(radix)])
        mode = F.array_position(own, F.array_max(own)) - 1  # the first of equal ones
        syn_code = syn_code + mode * F.lit(radix ** i)
    # largest-remainder allocation of the draws over minority rows
    alloc = (votes.join(minp.select(*keys, F.col("code").alias("a_code"), "m"), keys + ["a_code"])
             .join(tot.select(*keys, "n_new", "n_min", "minority"), keys))
    quota = F.col("n_new") * F.col("m") / F.col("n_min")
    alloc = alloc.select(*keys, "a_code", "minority", "n_new", syn_code.alias("s_code"),
                         F.floor(quota).alias("base"), (quota - F.floor(quota)).alias("frac"))
    wr = Window.partitionBy(*keys).orderBy(F.col("frac").desc(), F.col("a_code"))
    wk = Window.partitionBy(*keys)
    alloc = (alloc.withColumn("_left", F.col("n_new") - F.sum("base").over(wk))
             .withColumn("_rr", F.row_number().over(wr))
             .withColumn("draws", F.col("base") + F.when(F.col("_rr") <= F.col("_left"), 1)
                         .otherwise(0))
             .where(F.col("draws") > 0))
    out = alloc.groupBy(*keys, "s_code", "minority").agg(F.sum("draws").alias("n"))
    feats = [value_of("s_code", i, values).alias(f) for i, f in enumerate(features)]
    out = out.select(*keys, *feats, F.col("n").cast("long").alias("n"),
                     F.when(F.col("minority") == 0, F.col("n")).otherwise(0).cast("double").alias("w0"),
                     F.when(F.col("minority") == 1, F.col("n")).otherwise(0).cast("double").alias("w1"),
                     F.lit(True).alias("is_synthetic"))
    return out.drop("_k") if drop_key else out


def oversample(pats: DataFrame, features: list[str], keys: list[str] | tuple = (),
               method: str = "smoten", values=BINARY) -> DataFrame:
    """Original patterns + synthetic ones (flagged), summed per pattern."""
    if method != "smoten":
        raise ValueError("pattern oversampling supports 'smoten'; use smote_rows for SMOTE")
    syn = smoten(pats, features, list(keys), values=values)
    orig = pats.select(*keys, *features, "n", "w0", "w1").withColumn("is_synthetic", F.lit(False))
    return orig.unionByName(syn)


def smote_rows(rows: DataFrame, features: list[str], label: str = "label",
               id_col: str = "paper_id", k: int = SMOTE_K, seed: int = 42,
               values=BINARY) -> DataFrame:
    """M1 (numeric SMOTE): new = x + u * (neighbour - x).

    Base row, neighbour (one of the k nearest rows by Euclidean distance) and
    u come from md5 of (seed, draw index): reproducible and
    partition-independent.  This makes fractional features, as the method
    does.  Returns the synthetic rows."""
    from .split import class_rank
    tot = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    stats = tot.agg(F.min("c").alias("n_min"), F.max("c").alias("n_maj"),
                    F.min_by(label, F.struct("c", label)).alias("mino")).first()
    n_new, n_min, mino = int(stats["n_maj"] - stats["n_min"]), int(stats["n_min"]), stats["mino"]
    mr = rows.where(F.col(label) == mino).select(id_col, label, *features)
    if n_new == 0 or n_min < 2:
        return mr.limit(0).select(*features, label).withColumn("is_synthetic", F.lit(True))
    code = pattern_code(features, values)
    # exact positions of the minority rows without a one-partition sort
    ranked = class_rank(mr, label, id_col, seed).select(
        "_rank", code.alias("code"))
    minp = (ranked.groupBy("code").agg(F.count(F.lit(1)).alias("m"))
            .withColumn("n_min", F.lit(n_min)).withColumn("_k", F.lit(0)))
    nb = nearest_rows(cut_lineage(minp), ["_k"], k, squared_costs(len(features), values), values)
    wn = Window.partitionBy("a_code").orderBy("dist", "b_code")
    nb = (nb.withColumn("_hi", F.sum("take").over(wn.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_lo", F.col("_hi") - F.col("take")))
    kk = nb.groupBy("a_code").agg(F.max("_hi").alias("_kk"))
    spark = rows.sparkSession

    def h(salt):
        return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(salt),
                                                    F.col("id").cast("string"))), 1, 12),
                      16, 10).cast("double")
    draws = spark.range(n_new).select(
        F.pmod(h("row"), F.lit(float(n_min))).cast("long").alias("_rank"),
        h("nb").alias("_h"), (h("u") / F.lit(float(16 ** 12))).alias("u"))
    base = (draws.join(ranked, "_rank").withColumnRenamed("code", "a_code")
            .join(bounded_broadcast(kk), "a_code")  # one row per minority pattern
            .withColumn("_j", F.pmod(F.col("_h"), F.col("_kk"))))
    pick = base.join(nb, "a_code").where((F.col("_j") >= F.col("_lo")) & (F.col("_j") < F.col("_hi")))
    out = []
    for i, f in enumerate(features):
        xa, xb = value_of("a_code", i, values), value_of("b_code", i, values)
        out.append((xa + F.col("u") * (xb - xa)).alias(f))
    return pick.select(*out, F.lit(mino).alias(label), F.lit(True).alias("is_synthetic"))
