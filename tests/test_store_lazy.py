import datetime as dt

from pyspark.sql import functions as F

from papersieve.operators import store as ST
from papersieve.operators.rules import ReplayProvider, RuleProvider
from papersieve.operators.tree import fixture_nodes
from papersieve.plans.lazy import lazy_walk, new_answers
from papersieve.plans.screen import prepare, tree_walk
from papersieve.sources import tables as S
from papersieve.functions.answers import cache_payload

from .conftest import SF001


def _log(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, paper_id long, question_id string, "
                                     "answered_at timestamp, answer string")
    return df.select("event_id", "paper_id", "question_id", F.lit("m").alias("model"),
                     F.lit("single").alias("mode"), "answered_at",
                     F.when(F.col("answer").isNull(), F.lit('{"answer": ')).otherwise(
                         cache_payload("answer", F.lit("e"), F.lit(1), F.lit(2))).alias("payload"))


def test_ttl_boundary_and_newest_write(spark):
    t0 = dt.datetime(2024, 1, 31)
    ttl = 10 * 86400
    log = _log(spark, [
        (1, 1, "I01", t0 - dt.timedelta(days=10), "YES"),   # exactly TTL old: gone
        (2, 2, "I01", t0 - dt.timedelta(days=9), "NO"),     # live
        (3, 3, "I01", t0 - dt.timedelta(days=20), "NO"),    # old ...
        (4, 3, "I01", t0 - dt.timedelta(days=1), "YES"),    # ... rewritten: renewed, newest wins
        (5, 4, "I01", t0 - dt.timedelta(days=2), "NO"),
        (6, 4, "I01", t0 - dt.timedelta(days=1), None),     # newest write malformed: miss
    ])
    live = ST.live_answers(log, F.lit(t0).cast("timestamp"), ttl)
    got = {r["paper_id"]: r["answer"] for r in live.collect()}
    assert got == {2: "NO", 3: "YES"}


def test_hits_and_misses(spark):
    req = spark.createDataFrame([(1, "I01"), (1, "I01"), (2, "I04")], "paper_id long, question_id string")
    store = spark.createDataFrame([(1, "I01")], "paper_id long, question_id string")
    assert ST.cache_misses(req, store).collect() == [(2, "I04")]
    assert ST.cache_hits(req, store).count() == 2


def test_lazy_equals_eager_and_second_run_asks_nothing(spark):
    nodes = fixture_nodes(spark)
    papers = S.papers(spark, SF001)
    eager = {r["paper_id"]: (r["leaf_id"], r["probability"])
             for r in tree_walk(papers, nodes, trace=False).collect()}
    prepared = prepare(papers).cache()
    first = lazy_walk(prepared, nodes, RuleProvider()).cache()
    rows = first.collect()
    assert {r["paper_id"]: (r["leaf_id"], r["probability"]) for r in rows} == eager
    assert sum(r["n_asked"] for r in rows) == 409          # questions on the paths only
    assert all(r["n_asked"] == r["path_len"] for r in rows)
    store = new_answers(first)
    second = lazy_walk(prepared, nodes, RuleProvider(), store=store).collect()
    assert sum(r["n_asked"] for r in second) == 0
    assert {r["paper_id"]: (r["leaf_id"], r["probability"]) for r in second} == eager


def test_lazy_with_request_provider(spark):
    """A non-native provider answers a request table per level."""
    nodes = fixture_nodes(spark)
    prepared = prepare(S.papers(spark, SF001)).cache()
    answers = RuleProvider().answer_long(prepared, F.col("text"))
    got = lazy_walk(prepared, nodes, ReplayProvider(answers)).collect()
    eager = {r["paper_id"]: r["leaf_id"] for r in
             tree_walk(S.papers(spark, SF001), nodes, trace=False).collect()}
    assert {r["paper_id"]: r["leaf_id"] for r in got} == eager
