"""Neighbour search over many three-valued answers against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papersieve.operators import neighbours as N
from papersieve.operators.resample import smote_rows, smoten, vdm_neighbours
from papersieve.operators.train import patterns

from .brute import smoten_brute

FE = [f"Q{i:02d}" for i in range(29)]
V3 = N.THREE_VALUED


def rows_of(n, features, values, seed):
    """(id, label, answers): most answers 0, as in screening."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        few = draw.random() < .4
        out.append((i, int(draw.random() < .3),
                    *[draw.choice(values) if draw.random() < (.05 if few else .5) else 0.0
                      for _ in features]))
    return out


def frame(spark, rows, features):
    return spark.createDataFrame(rows, ["paper_id", "label", *features]).repartition(3)


def brute(rows, k, values):
    """a_code -> [(b_code, dist, take)] by looking at all pairs."""
    n = len(rows[0]) - 2
    share = [{v: (sum(r[1] for r in own) / len(own)) for v in values
              if (own := [r for r in rows if r[i + 2] == v])} for i in range(n)]
    minority = 1 if sum(r[1] for r in rows) * 2 <= len(rows) else 0
    codes = Counter(tuple(r[2:]) for r in rows if r[1] == minority)
    code = {p: sum(values.index(v) * len(values) ** i for i, v in enumerate(p)) for p in codes}
    k = min(k, codes.total() - 1)
    out = {}
    for p in codes:
        near = []
        for q, m in codes.items():
            d = 0.0
            for i, (x, y) in enumerate(zip(p, q)):
                d += (2.0 * abs(share[i][x] - share[i][y])) ** 2.0 if x != y else 0.0
            near.append((d, code[q], m - (p == q)))
        left, own = k, []
        for d, c, m in sorted(x for x in near if x[2]):
            take = min(m, left)
            if take:
                own.append((c, round(d, 9), take))
            left -= take
        out[code[p]] = own
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.a_code, []).append((round(r.dist, 9), r.b_code, r["take"]))
    return {a: [(c, d, t) for d, c, t in sorted(x)] for a, x in out.items()}


@pytest.mark.parametrize("block", [N.BLOCK, 11])
def test_29_three_valued_questions_equal_brute_force(spark, monkeypatch, block):
    rows = rows_of(260, FE, V3, 1)
    pats = patterns(frame(spark, rows, FE), FE)
    monkeypatch.setattr(N.nearest_rows, "__defaults__", (N.BINARY, block))
    assert found(vdm_neighbours(pats, FE, 5, V3)) == brute(rows, 5, V3)


def test_a_category_without_rows_and_equal_shares(spark):
    rows = [(i, i % 4 == 0, 0.5 if i % 2 else 1.0, float(i % 3 == 0), 0.0) for i in range(40)]
    rows = [(a, int(b), c, d, e) for a, b, c, d, e in rows]
    names = FE[:3]
    pats = patterns(frame(spark, rows, names), names)
    assert found(vdm_neighbours(pats, names, 3, V3)) == brute(rows, 3, V3)


def test_other_values_raise(spark):
    df = frame(spark, [(1, 0, 0.5), (2, 1, 0.0), (3, 0, 1.0)], FE[:1])
    with pytest.raises(Exception, match="no category for 0.5"):
        df.select(N.pattern_code(FE[:1])).collect()
    codes = df.select(F.col(FE[0]), N.pattern_code(FE[:1], V3).alias("c")).collect()
    assert {(r[0], r.c) for r in codes} == {(0.0, 0), (0.5, 1), (1.0, 2)}


def test_smoten_of_two_values_is_as_before(spark):
    names = FE[:6]
    rows = rows_of(90, names, (0.0, 1.0), 4)
    got = {tuple(r[f] for f in names): r["n"] for r in smoten(patterns(frame(spark, rows, names), names),
                                                             names).collect()}
    want, _ = smoten_brute([(r[2:], r[1]) for r in rows], names)
    assert got == want


def test_smote_lies_between_a_row_and_a_neighbour(spark):
    rows = rows_of(120, FE, V3, 6)
    syn = smote_rows(frame(spark, rows, FE), FE, k=3, values=V3).collect()
    minority = 1 if sum(r[1] for r in rows) * 2 <= len(rows) else 0
    counts = Counter(r[1] for r in rows)
    assert len(syn) == abs(counts[0] - counts[1])
    own = [r[2:] for r in rows if r[1] == minority]
    for r in syn[:40]:
        x = tuple(r[f] for f in FE)
        assert any(all(min(a, b) - 1e-9 <= v <= max(a, b) + 1e-9 for a, b, v in zip(p, q, x))
                   for p in own for q in own)


def test_no_list_of_masks(spark):
    pats = patterns(frame(spark, rows_of(40, FE, V3, 2), FE), FE)
    plan = vdm_neighbours(pats, FE, 5, V3)._jdf.queryExecution().optimizedPlan().toString()
    assert "mask" not in plan and len(plan) < 100_000
