"""Physical-plan properties the design relies on (checked with explain)."""

from papersieve.operators import metrics as M
from papersieve.operators.tree import fixture_nodes
from papersieve.plans.catalog import scored_labelled, training
from papersieve.plans.screen import screen
from papersieve.sources import tables as S

from .conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_screen_is_map_side_only(spark):
    p = _plan(screen(S.papers(spark, SF01), fixture_nodes(spark)))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p
    assert "HashAggregate" not in p and "Window" not in p
    # the only exchange is the small-input spread (hash on paper_id) and the
    # broadcasts of the node table
    ex = [ln for ln in p.splitlines() if "Exchange" in ln and "Broadcast" not in ln]
    assert all("hashpartitioning(paper_id" in ln for ln in ex), ex
    # the scan reads only the two columns it needs
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_sweep_preaggregates_before_fanout(spark):
    p = _plan(M.threshold_sweep(scored_labelled(spark, SF01)))
    # the threshold generator sits above an aggregate of (probability, label)
    gen = p.index("Generate")
    assert "HashAggregate" in p[gen:]


def test_conflicts_broadcast_pattern_table(spark):
    from papersieve.constants import FEATURE_ORDER as FE
    from papersieve.operators.conflicts import conflicts_majority
    p = _plan(conflicts_majority(training(spark, SF01), FE))
    assert "BroadcastHashJoin" in p and "Window" not in p


def test_trained_screen_walks_the_searched_tree(spark):
    from papersieve.plans.catalog import FEATS, FLOW_GRID, encoded_split, q_trained_screen
    from papersieve.plans.training import search_and_fit
    d = "/root/testdata/sf0.001"
    config, nodes = search_and_fit(encoded_split(spark, d), FEATS, FLOW_GRID)
    table = {r["node_id"]: r for r in nodes.collect()}
    assert config["max_depth"] in FLOW_GRID["max_depth"]
    rows = q_trained_screen(spark, d).collect()
    assert len(rows) == 200 and {r["status"] for r in rows} == {"done", "excluded"}
    for r in rows:
        if r["status"] == "done":
            leaf = table[r["leaf_id"]]
            assert leaf["feature"] is None
            assert abs(r["probability"] - leaf["n1"] / (leaf["n0"] + leaf["n1"])) < 1e-12
