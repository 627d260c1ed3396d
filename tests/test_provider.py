import pandas as pd
from pyspark.sql import functions as F

from papersieve.operators.rules import PandasProvider


def _model(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[["paper_id", "question_id"]].copy()
    out["answer"] = ["YES" if "x" in a else "NO" for a in pdf["abstract"]]
    out["evidence"] = ""
    out["prompt_tokens"] = pdf["abstract"].str.len().astype("int64")
    out["completion_tokens"] = 1
    return out


def test_pandas_provider_bounded_parallelism(spark):
    req = spark.createDataFrame(
        [(i, q, "", "x" if i % 2 else "y", "question") for i in range(20) for q in ("I01", "I04")],
        "paper_id long, question_id string, title string, abstract string, question string")
    p = PandasProvider(_model, "my-model", parallelism=3)
    got = p.answer_requests(req)
    rows = got.collect()
    assert len(rows) == 40
    assert all(r["answer"] == ("YES" if r["paper_id"] % 2 else "NO") for r in rows)
    assert all(r["model"] == "my-model" for r in rows)
    # the provider stage runs in exactly `parallelism` tasks
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan or "MapInArrow" in plan or "PythonMapInArrow" in plan


def test_lazy_screen_with_every_provider(spark, tmp_path):
    """Rules, replayed answers and a caller's model screen alike; the model is
    asked each (paper, question) once, with the question's text."""
    from papersieve.constants import EXCLUSION_REASONS
    from papersieve.operators.rules import ReplayProvider, RuleProvider
    from papersieve.operators.tree import fixture_nodes
    from papersieve.plans.lazy import lazy_screen
    from papersieve.plans.screen import prepare
    from papersieve.sources import tables as S

    prepared = prepare(S.papers(spark, "/root/testdata/sf0.001")).cache()
    nodes = fixture_nodes(spark)
    rules = RuleProvider()
    answers = rules.answer_long(prepared, F.col("text")).cache()
    known = {(r["paper_id"], r["question_id"]): r["answer"] for r in answers.collect()}
    calls = str(tmp_path / "calls")

    def model(pdf):
        import os
        import uuid
        os.makedirs(calls, exist_ok=True)
        pdf[["paper_id", "question_id", "question", "mode"]].to_csv(
            f"{calls}/{uuid.uuid4().hex}.csv", index=False, header=False)
        if pdf["mode"].iloc[0] == "exclusion":
            out = pdf[["paper_id"]].copy()
            out["ids"] = [[i for i, r in enumerate(EXCLUSION_REASONS) if known[p, r] != "NO"]
                          for p in pdf["paper_id"]]
            out["evidence"] = ""
            return out
        out = pdf[["paper_id", "question_id"]].copy()
        out["answer"] = [known[k] for k in zip(pdf["paper_id"], pdf["question_id"])]
        out["evidence"] = ""
        out["prompt_tokens"] = out["completion_tokens"] = 1
        return out

    def screened(provider):
        rows = lazy_screen(prepared, nodes, provider).select(
            "paper_id", "status", "excluded_by", "leaf_id", "probability", "n_asked").collect()
        return sorted(map(tuple, rows), key=str)

    want = screened(rules)
    replies = answers.where(F.col("question_id").isin(*EXCLUSION_REASONS)).groupBy("paper_id").agg(
        F.array_sort(F.filter(F.collect_list(F.when(F.col("answer") != "NO", F.array_position(
            F.array(*[F.lit(r) for r in EXCLUSION_REASONS]), F.col("question_id")) - 1)),
            lambda x: x.isNotNull())).alias("ids")).withColumn("evidence", F.lit(""))
    assert screened(ReplayProvider(answers, selections=replies)) == want
    assert screened(PandasProvider(model, "m")) == want
    import glob
    asked = pd.concat(pd.read_csv(f, header=None, keep_default_na=False)
                      for f in glob.glob(f"{calls}/*.csv"))
    assert not asked.duplicated([0, 1, 3]).any()
    # every request that was sent is counted, and no other
    assert len(asked) == sum(r[-1] for r in want)
    assert set(asked[3]) == {"exclusion", "confirm", "single"}
    assert (asked[2].str.len() > 10).all()


def test_malformed_write_hides_no_answer(spark, tmp_path):
    from datetime import datetime, timedelta

    from papersieve.streaming.stream import stream_dedupe
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0, 7, "error"), (2, t0 + timedelta(minutes=1), 7, "click"),
            (3, t0 + timedelta(minutes=2), 7, "view")]
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0)
    cast = {f.name: f.dataType for f in df.schema}
    made = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    full = made.select(*[
        (F.col(c) if c in made.columns else F.lit('{"k": 1}') if c == "props" else F.lit(1.0))
        .cast(cast[c]).alias(c) for c in df.columns])
    pdf = full.toPandas()
    pdf["ts"] = pdf["ts"].astype("datetime64[us]")
    pdf.to_parquet(tmp_path / "events.parquet")
    got = spark.read.parquet(stream_dedupe(spark, str(tmp_path))).collect()
    assert len(got) == 1


def test_poisson_draws_follow_one_law():
    import numpy as np

    from papersieve.plans.training import _poisson_batch
    rng = np.random.default_rng(0)
    for rate in (0.5, 3.0, 199.0, 201.0, 1e6):
        x = _poisson_batch(np.full(4000, rate), rng.random(4000))
        assert abs(x.mean() - rate) < 5 * np.sqrt(rate / 4000)
        assert abs(x.var() / rate - 1) < 0.15


def _papers(spark, n):
    return spark.createDataFrame([(i, "", f"paper {i}", f"paper {i}") for i in range(n)],
                                 "paper_id long, title_clean string, abstract_clean string, text string")


def test_precheck_order_failures_and_store(spark):
    """Confirmations go in the reply's order and stop at the first YES; UNSURE
    does not exclude; ids out of range, no reply and failed confirmations have
    their own status; the store's confirmations are not asked."""
    from papersieve.constants import EXCLUSION_REASONS as R
    from papersieve.operators.rules import ReplayProvider
    from papersieve.plans.precheck import precheck
    replies = spark.createDataFrame(
        [(0, [2, 0]), (1, [0, 2]), (2, [1, 99]), (3, []), (5, [1, 2]), (6, [1, 1, 0]), (7, [0])],
        "paper_id long, ids array<int>").withColumn("evidence", F.lit("r"))
    said = {(0, 0): "YES", (0, 2): "YES", (1, 0): "UNSURE", (1, 2): "NO", (5, 2): "YES",
            (6, 1): "NO", (6, 0): "YES"}
    answers = spark.createDataFrame(
        [(p, R[i], "confirm", a, f"{p}:{i}", 1, 1) for (p, i), a in said.items()],
        "paper_id long, question_id string, mode string, answer string, evidence string, "
        "prompt_tokens long, completion_tokens long")
    store = spark.createDataFrame([(7, R[0], "confirm", "YES", "old"), (1, R[0], "single", "YES", "x")],
                                  "paper_id long, question_id string, mode string, answer string, "
                                  "evidence string")
    got = {r.paper_id: (r.exclusion_status, r.excluded_reason, r.exclusion_evidence,
                        r.n_exclusion_calls, r.n_exclusion_hits)
           for r in precheck(_papers(spark, 8), ReplayProvider(answers, selections=replies),
                             store=store).collect()}
    assert got == {0: ("excluded", 2, "0:2", 2, 0), 1: ("pass", None, None, 3, 0),
                   2: ("invalid", None, None, 1, 0), 3: ("pass", None, None, 1, 0),
                   4: ("unanswered", None, None, 1, 0),
                   5: ("unanswered", None, None, 2, 0),  # reason 1 has no answer
                   6: ("excluded", 0, "6:0", 3, 0), 7: ("excluded", 0, "old", 1, 1)}


def test_malformed_selections(spark):
    from papersieve.plans.precheck import parse_selection
    texts = ['{"ids":[2,0],"evidence":"e"}', '{"ids":[]}', '{"ids":"2"}', '{"evidence":"e"}', "{", None,
             '{"ids":[1,null]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p and r.p.ids for r in df.select("i", parse_selection("t").alias("p")).collect()}
    assert got == {0: [2, 0], 1: [], 2: None, 3: None, 4: None, 5: None, 6: None}


def test_a_failing_row_is_unanswered_and_a_rerun_asks_it_alone(spark, tmp_path):
    from papersieve.operators.rules import ask_logged
    calls, fixed = tmp_path / "calls", tmp_path / "fixed"
    calls.mkdir()

    def model(pdf):
        import os
        import uuid
        if (pdf["paper_id"] == 13).any() and not os.path.exists(fixed):
            raise RuntimeError("no answer for 13")
        pdf[["paper_id"]].to_csv(f"{calls}/{uuid.uuid4().hex}.csv", index=False, header=False)
        out = pdf[["paper_id", "question_id"]].copy()
        out["answer"], out["evidence"] = "YES", "e"
        out["prompt_tokens"] = out["completion_tokens"] = 1
        return out

    req = spark.createDataFrame([(i, "I01", "single", "q", "t", "a") for i in range(40)],
                                "paper_id long, question_id string, mode string, question string, "
                                "title string, abstract string")
    p = PandasProvider(model, "m", parallelism=2, in_flight=3, rows_per_call=6, retries=1, backoff=0.01)
    errors = {r.paper_id: r.error for r in p.answer_requests(req).collect() if r.answer is None}
    assert set(errors) == {13} and "no answer for 13" in errors[13]
    for f in calls.iterdir():
        f.write_text("")
    log = str(tmp_path / "log")
    first = ask_logged(p, req, log, per_wave=15).collect()
    assert sorted(r.paper_id for r in first if r.answer is None) == [13] and len(first) == 40
    before = sum(len(f.read_text().split()) for f in calls.iterdir())
    assert before == 39
    fixed.write_text("x")
    again = ask_logged(p, req, log).collect()
    assert all(r.answer == "YES" for r in again) and len(again) == 40
    assert sum(len(f.read_text().split()) for f in calls.iterdir()) == before + 1


def test_replies_of_any_shape(spark):
    from papersieve.plans.extract import parse_replies
    texts = ['{"i01": "YES", "I4": {"answer": "NO", "evidence": "e"}, "e02": "UNSURE"}',
             '[{"id": "i1", "answer": "YES"}, {"question_id": "E02", "answer": "NO"}, 7, "YES", null]',
             '{"i01": "maybe", "I99": "YES", "x": "NO", "I04": null, "E02": ["YES"]}',
             '{"i01": "YES", "I1": "NO", "i04": "YES", "I04": "YES"}', "{", "7", '"YES"', "[]", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "paper_id long, payload string")
    got = {}
    for r in parse_replies(df, ["I01", "I04", "E02"]).collect():
        got.setdefault(r.paper_id, {})[r.question_id] = r.answer
    assert got == {0: {"I01": "YES", "I04": "NO", "E02": "UNSURE"}, 1: {"I01": "YES", "E02": "NO"},
                   3: {"I04": "YES"}}


def test_extraction_with_every_provider(spark):
    """Rules, a replay and a caller's model extract alike; a failing paper is
    incomplete and does not end the job."""
    from papersieve.operators.rules import ReplayProvider, RuleProvider
    from papersieve.plans.extract import extract_long, extract_unpivot
    from papersieve.plans.screen import prepare
    from papersieve.sources import tables as S
    qids = ["I01", "I05", "E02", "E03"]
    prepared = prepare(S.papers(spark, "/root/testdata/sf0.001")).where("paper_id < 60").cache()
    answers = RuleProvider().answer_long(prepared, F.col("text"), qids=qids).cache()
    known = {(r["paper_id"], r["question_id"]): r["answer"] for r in answers.collect()}

    def model(pdf):
        import json
        if (pdf["paper_id"] == 7).any():
            raise RuntimeError("no")
        if pdf["mode"].iloc[0] == "all":
            return pdf[["paper_id"]].assign(payload=[json.dumps({
                q[0].lower() + q[1:]: known[p, q] for q in qids}) for p in pdf["paper_id"]])
        out = pdf[["paper_id", "question_id"]].copy()
        out["answer"] = [known[k] for k in zip(pdf["paper_id"], pdf["question_id"])]
        out["evidence"], out["prompt_tokens"], out["completion_tokens"] = "", 2, 1
        return out

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)

    rules = rows(extract_long(prepared, RuleProvider(), qids).drop("input_tokens", "output_tokens"))
    plan = extract_long(prepared, RuleProvider(), qids)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(paper_id" not in plan.split("InMemoryRelation")[0]
    replayed = extract_long(prepared, ReplayProvider(answers), qids)
    assert rows(replayed.drop("input_tokens", "output_tokens")) == rules
    asked = extract_long(prepared, PandasProvider(model, "m", rows_per_call=9), qids)
    assert rows(asked.where("paper_id <> 7").drop("input_tokens", "output_tokens")) == [
        r for r in rules if r[0] != 7]
    failed = asked.where("paper_id = 7").first()
    assert failed.status == "incomplete" and failed.I01 is None and failed.input_tokens == 0
    assert asked.agg(F.sum("input_tokens"), F.sum("output_tokens")).first()[:] == (59 * 8, 59 * 4)
    wide = rows(extract_unpivot(prepared, RuleProvider(), qids))
    got = extract_unpivot(prepared, PandasProvider(model, "m", rows_per_call=9), qids)
    assert rows(got.where("paper_id <> 7")) == [r for r in wide if r[0] != 7]
    assert {r.answer for r in got.where("paper_id = 7").collect()} == {None}


def test_stored_answers_are_not_asked_again(spark):
    from papersieve.plans.extract import extract_long
    papers = _papers(spark, 6)
    store = spark.createDataFrame([(i, "I01", "single", "YES", 5, 5) for i in range(4)],
                                  "paper_id long, question_id string, mode string, answer string, "
                                  "prompt_tokens long, completion_tokens long")

    def model(pdf):
        assert (pdf["paper_id"] >= 4).all()
        out = pdf[["paper_id", "question_id"]].copy()
        out["answer"], out["evidence"], out["prompt_tokens"], out["completion_tokens"] = "NO", "", 1, 1
        return out

    got = extract_long(papers, PandasProvider(model, "m"), ["I01"], store=store).collect()
    assert {r.paper_id: (r.status, r.I01, r.input_tokens) for r in got} == {
        i: ("complete", 1.0, 5) if i < 4 else ("complete", 0.0, 1) for i in range(6)}
