from pyspark.sql import functions as F

from papersieve.operators.tree import enrich_nodes, fixture_nodes, walk


def answers_df(spark, rows):
    """rows: paper_id -> {question: answer}"""
    data = [(pid, {q: (a, "ev") for q, a in ans.items()}) for pid, ans in rows.items()]
    return spark.createDataFrame(
        data, "paper_id long, answers map<string, struct<answer:string, evidence:string>>")


def test_fixture_walks(spark):
    df = answers_df(spark, {
        1: {"I16": "UNSURE", "I13": "YES", "I01": "UNSURE"},
        2: {"I16": "NO", "I04": "UNSURE"},
        3: {"I16": "YES", "I13": "NO"},
        4: {"I16": "YES"},
    })
    out = {r["paper_id"]: r for r in walk(df, fixture_nodes(spark)).collect()}
    assert out[1]["leaf_id"] == 7 and abs(out[1]["probability"] - 80 / 90) < 1e-12
    assert [(t["question_id"], t["answer"]) for t in out[1]["trace"]] == [
        ("I16", "UNSURE"), ("I13", "YES"), ("I01", "UNSURE")]
    assert [round(t["inclusion_score"], 4) for t in out[1]["trace"]] == [0.5714, 0.6667, 0.8889]
    assert out[2]["leaf_id"] == 4 and round(out[2]["probability"], 4) == 0.2727
    assert out[3]["leaf_id"] == 5 and out[3]["probability"] == 0.0
    assert out[4]["status"] == "unanswered" and out[4]["probability"] is None


def test_unsure_tie_goes_right(spark):
    from papersieve.operators.tree import NODE_SCHEMA
    rows = [("t", 0, 0, 0, "I01", 0.5, 1, 2, 5.0, 5.0, 0.5),
            ("t", 0, 1, 1, None, None, -1, -1, 1.0, 1.0, 0.5),
            ("t", 0, 2, 1, None, None, -1, -1, 2.0, 2.0, 0.5)]
    nodes = spark.createDataFrame(rows, NODE_SCHEMA)
    assert enrich_nodes(nodes).where("node_id = 0").first()["unsure_id"] == 2
    df = answers_df(spark, {1: {"I01": "UNSURE"}})
    assert walk(df, nodes).first()["leaf_id"] == 2


def test_encoded_walk_sends_unsure_right(spark):
    df = spark.createDataFrame([(1, {"I16": 1.0, "I13": 1.0, "I01": 1.0})],
                               "paper_id long, x map<string, double>")
    r = walk(df, fixture_nodes(spark), "x", mode="encoded").first()
    assert r["leaf_id"] == 8   # C2 would go to 7 on UNSURE at node 6


def test_walk_takes_long_node_ids(spark):
    """Ids of a tree without depth limit do not fit an int; the screen keeps
    them, and its flow searches the whole grid of M8."""
    from papersieve.operators.tree import NODE_SCHEMA
    from papersieve.plans.catalog import FLOW_GRID
    from papersieve.plans.screen import screen
    from papersieve.plans.training import expand_grid
    from pyspark.sql import types as T
    assert len(expand_grid(FLOW_GRID)) == 819
    far = 1 << 40
    long_ids = T.StructType([
        T.StructField(f.name, T.LongType()) if f.name.endswith("_id") and f.name not in
        ("run_id", "tree_id") else f for f in NODE_SCHEMA])
    nodes = spark.createDataFrame(
        [("t", 0, 0, 0, "I16", 0.5, far + 1, far + 2, 4.0, 4.0, 0.5),
         ("t", 0, far + 1, 1, None, None, -1, -1, 3.0, 1.0, 0.375),
         ("t", 0, far + 2, 1, None, None, -1, -1, 1.0, 3.0, 0.375)], long_ids)
    df = answers_df(spark, {1: {"I16": "YES"}, 2: {"I16": "NO"}, 3: {"I16": "UNSURE"}, 4: {}})
    got = {r["paper_id"]: r["leaf_id"] for r in walk(df, nodes).collect()}
    assert got == {1: far + 2, 2: far + 1, 3: far + 2, 4: None}
    papers = spark.createDataFrame([(1, "A title", "An abstract")],
                                   "paper_id long, title string, abstract string")
    assert screen(papers, nodes).first()["leaf_id"] in (None, far + 1, far + 2)
