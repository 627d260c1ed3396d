"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the driver's tables, so its
work grows with them.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_title, html_to_text
from ..operators import metrics as M
from ..constants import EXCLUSION_REASONS
from ..operators.rules import ReplayProvider, RuleProvider
from ..operators.tree import fixture_nodes, leaf_assign
from ..sources import tables as S
from . import oracle as O
from .screen import exclusion_check, prepare, screen, tree_walk

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- shared plans

def _flat(papers: DataFrame, spark: SparkSession) -> DataFrame:
    s = screen(papers, fixture_nodes(spark))
    return s.select("paper_id", "status", "excluded_by", "leaf_id", "probability",
                    "prediction", "n_steps")


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat screen of every document against the fixture tree."""
    return _flat(S.papers(spark, sf_dir), spark)


def scored_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen of the labelled papers only (a semi join before the text work),
    with their labels."""
    lab = S.labels(spark, sf_dir)
    papers = S.papers(spark, sf_dir).join(lab.select("paper_id"), "paper_id", "left_semi")
    return _flat(papers, spark).join(lab, "paper_id")


SCREEN_SQL = "WITH RECURSIVE " + O.screen_ctes()
SCORED_SQL = (SCREEN_SQL + ", " + O.labels_cte() +
              ", st AS (SELECT s.*, s.probability AS p, l.label AS y FROM sc s JOIN lab l USING (paper_id))")


# ---------------------------------------------------------------- F1, F2, C7

@register("ascii_fold", f"WITH {O.docs_cte()} SELECT paper_id, text AS abstract_clean FROM docs")
def q_ascii_fold(spark, sf_dir):
    return prepare(S.papers(spark, sf_dir)).select("paper_id", "abstract_clean")


@register("html_to_text",
          "SELECT page_id AS paper_id, "
          "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1) AS title, "
          f"{O.sql_html_to_text('html')} AS body FROM pages")
def q_html_to_text(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("paper_id"), html_title("html").alias("title"),
                    html_to_text("html").alias("body"))


@register("rule_answers", f"WITH {O.docs_cte()} {O.rules_long_sql()}")
def q_rule_answers(spark, sf_dir):
    d = prepare(S.papers(spark, sf_dir))
    return RuleProvider().answer_long(d, F.col("text")).select(
        "paper_id", "question_id", "answer", "evidence")


# ---------------------------------------------------------------- C1, C2, C4

@register("tree_walk",
          f"WITH RECURSIVE {O.docs_cte()}, {O.rules_wide_cte()}, {O.fixture_ctes()}, "
          f"{O.walk_ctes()} SELECT paper_id, leaf_id, probability, path_len, "
          "'done' AS status FROM wres")
def q_tree_walk(spark, sf_dir):
    w = tree_walk(S.papers(spark, sf_dir), fixture_nodes(spark), trace=False)
    return w.select("paper_id", "leaf_id", "probability", "path_len", "status")


@register("walk_trace",
          f"WITH RECURSIVE {O.docs_cte()}, {O.rules_wide_cte()}, {O.fixture_ctes()}, "
          f"{O.walk_ctes()} SELECT paper_id, path_len - 1 AS step, step_node AS node_id, "
          "step_q AS question_id, step_a AS answer, step_score AS inclusion_score "
          "FROM walk WHERE step_q IS NOT NULL")
def q_walk_trace(spark, sf_dir):
    w = tree_walk(S.papers(spark, sf_dir), fixture_nodes(spark), trace=True)
    return w.select("paper_id", F.inline("trace")).select(
        "paper_id", "step", "node_id", "question_id", "answer", "inclusion_score")


@register("exclusion_check",
          f"WITH {O.docs_cte()}, {O.rules_wide_cte()}, {O.exclusion_cte()} "
          "SELECT paper_id, CASE WHEN excluded_reason IS NULL THEN 'pass' ELSE 'excluded' END "
          "AS exclusion_status, excluded_reason, "
          f"{O.reason_qid('excluded_reason')} AS excluded_by FROM ex")
def q_exclusion_check(spark, sf_dir):
    d = exclusion_check(prepare(S.papers(spark, sf_dir)))
    return d.select("paper_id", "exclusion_status", "excluded_reason", "excluded_by")


@register("screen", SCREEN_SQL + " SELECT * FROM sc")
def q_screen(spark, sf_dir):
    return screened(spark, sf_dir)


@register("html_screen",
          "WITH RECURSIVE " + O.screen_ctes(O.pages_cte("docs")) + " SELECT * FROM sc")
def q_html_screen(spark, sf_dir):
    s = screen(S.html_papers(spark, sf_dir), fixture_nodes(spark))
    return s.select("paper_id", "status", "excluded_by", "leaf_id", "probability",
                    "prediction", "n_steps")


# ---------------------------------------------------------------- A7, A8, W3, F10, P5

@register("metrics_at_half",
          SCORED_SQL + ", m AS (SELECT " + O.confusion_sql("y", "prediction") +
          " FROM st) SELECT tp, fn, fp, tn, " + O.METRICS_SQL + " FROM m")
def q_metrics_at_half(spark, sf_dir):
    return M.confusion(scored_labelled(spark, sf_dir), "label", "prediction")


@register("threshold_sweep", SCORED_SQL + ", " + O.sweep_ctes() + " SELECT * FROM sw")
def q_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(scored_labelled(spark, sf_dir))


@register("best_threshold",
          SCORED_SQL + ", " + O.sweep_ctes() +
          " SELECT *, CASE WHEN recall >= 0.95 THEN 1 ELSE 0 END AS meets_target FROM sw "
          "ORDER BY CASE WHEN recall >= 0.95 THEN 1 ELSE 0 END DESC, "
          "CASE WHEN recall >= 0.95 THEN i END DESC NULLS LAST, recall DESC, i ASC LIMIT 1")
def q_best_threshold(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(scored_labelled(spark, sf_dir)), "max_recall")


@register("scored_truth",
          SCORED_SQL + " SELECT paper_id, y AS label, prediction, probability, "
          "CASE WHEN y = 1 AND prediction = 1 THEN 'TP' WHEN y = 1 AND prediction = 0 THEN 'FN' "
          "WHEN y = 0 AND prediction = 1 THEN 'FP' WHEN y = 0 AND prediction = 0 THEN 'TN' END "
          "AS prediction_class FROM st")
def q_scored_truth(spark, sf_dir):
    from ..functions.answers import outcome_class
    d = scored_labelled(spark, sf_dir)
    return d.select("paper_id", "label", "prediction", "probability",
                    outcome_class("label", "prediction").alias("prediction_class"))


@register("false_negatives",
          SCORED_SQL + " SELECT paper_id, probability, leaf_id, status FROM st "
          "WHERE y = 1 AND prediction = 0")
def q_false_negatives(spark, sf_dir):
    return M.false_negatives(scored_labelled(spark, sf_dir)).select(
        "paper_id", "probability", "leaf_id", "status")


# ---------------------------------------------------------------- J10, A11, A12

WALK_LABELLED_SQL = (
    f"WITH RECURSIVE {O.docs_cte()}, {O.rules_wide_cte()}, {O.fixture_ctes()}, {O.walk_ctes()}, "
    f"{O.labels_cte()}, wl AS (SELECT w.paper_id, w.leaf_id, w.probability, l.label AS y, "
    "n.n0 + n.n1 AS leaf_support, n.impurity AS leaf_impurity "
    "FROM wres w JOIN lab l USING (paper_id) JOIN fx n ON n.node_id = w.leaf_id)")


def walked_labelled(spark, sf_dir):
    nodes = fixture_nodes(spark)
    lab = S.labels(spark, sf_dir)
    # labelled papers only: cleaned, asked and walked after the semi join
    papers = S.papers(spark, sf_dir).join(lab.select("paper_id"), "paper_id", "left_semi")
    return leaf_assign(tree_walk(papers, nodes, trace=False), nodes).join(lab, "paper_id")


@register("leaf_assign",
          WALK_LABELLED_SQL + " SELECT paper_id, leaf_id, leaf_support, leaf_impurity FROM wl")
def q_leaf_assign(spark, sf_dir):
    return walked_labelled(spark, sf_dir).select("paper_id", "leaf_id", "leaf_support",
                                                 "leaf_impurity")


@register("purity_metrics",
          WALK_LABELLED_SQL +
          ", pm AS (SELECT CASE WHEN leaf_impurity = 0 THEN 'pure' ELSE 'impure' END AS subset, "
          "y, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS pred FROM wl), "
          "pa AS (SELECT coalesce(subset, 'all') AS subset, count(*) AS n, "
          + O.confusion_sql("y", "pred") + " FROM pm GROUP BY GROUPING SETS ((subset), ())) "
          "SELECT subset, n, tp, fn, fp, tn, " + O.METRICS_SQL + " FROM pa")
def q_purity_metrics(spark, sf_dir):
    return M.purity_metrics(walked_labelled(spark, sf_dir))


@register("leaf_recall",
          WALK_LABELLED_SQL +
          ", lr AS (SELECT leaf_id, leaf_support, count(*) AS n, "
          + O.confusion_sql("y", "CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END") +
          " FROM wl GROUP BY leaf_id, leaf_support) "
          "SELECT leaf_id, leaf_support, n, tp, fn, tp::DOUBLE / (tp + fn) AS recall "
          "FROM lr WHERE tp + fn > 0")
def q_leaf_recall(spark, sf_dir):
    return M.leaf_recall(walked_labelled(spark, sf_dir))



# ================================================================ batch 2
from ..constants import FEATURE_ORDER  # noqa: E402
from ..operators import conflicts as CF  # noqa: E402
from ..operators import features as FT  # noqa: E402
from ..operators import split as SP  # noqa: E402
from ..operators import store as ST  # noqa: E402
from . import extract as X  # noqa: E402
from .lazy import lazy_screen, lazy_walk  # noqa: E402
from .precheck import parse_selection, precheck  # noqa: E402

FEATS = FEATURE_ORDER
FEAT_SQL = ", ".join(FEATS)


def live(spark, sf_dir):
    log = S.answer_log(spark, sf_dir)
    asof = log.agg((F.max("answered_at") + F.expr("INTERVAL 15 DAYS")).alias("_asof"))
    # the as-of time is a one-row aggregate (a scalar), broadcast to the log
    return ST.live_answers(log.crossJoin(F.broadcast(asof)), F.col("_asof")).drop("_asof")


# ---------------------------------------------------------------- S3, F8, W4, A9, A10

@register("answers_scan", "WITH " + O.log_cte() +
          " SELECT event_id, paper_id, question_id, answer, evidence, prompt_tokens, "
          "completion_tokens, valid FROM alog")
def q_answers_scan(spark, sf_dir):
    return ST.parse_log(S.answer_log(spark, sf_dir)).select(
        "event_id", "paper_id", "question_id", "answer", "evidence", "prompt_tokens",
        "completion_tokens", "valid")


@register("live_answers", "WITH " + O.live_cte() +
          " SELECT paper_id, question_id, event_id, answer FROM live")
def q_live_answers(spark, sf_dir):
    return live(spark, sf_dir).select("paper_id", "question_id", "event_id", "answer")


@register("token_usage", "WITH " + O.live_cte() +
          " SELECT paper_id, sum(prompt_tokens)::BIGINT AS input_tokens, "
          "sum(completion_tokens)::BIGINT AS output_tokens, count(*) AS n_answers "
          "FROM live GROUP BY paper_id")
def q_token_usage(spark, sf_dir):
    return ST.token_usage(live(spark, sf_dir))


@register("answer_completeness", "WITH " + O.live_cte() +
          " SELECT paper_id, n_answered, 8 AS n_required, CASE WHEN n_answered = 8 THEN "
          "'complete' ELSE 'incomplete' END AS status FROM (SELECT paper_id, "
          "count(DISTINCT question_id) AS n_answered FROM live GROUP BY paper_id)")
def q_answer_completeness(spark, sf_dir):
    return ST.answer_completeness(live(spark, sf_dir), FEATS)


# ---------------------------------------------------------------- J3

def answer_requests(spark, sf_dir):
    """Every paper asked every tree question: (paper_id, question_id), a
    generator over the 8 questions (no join)."""
    return S.papers(spark, sf_dir).select(
        "paper_id", F.explode(F.array(*[F.lit(q) for q in FEATS])).alias("question_id"))


REQ_SQL = ("WITH " + O.live_cte() + ", req AS (SELECT d.doc_id AS paper_id, q.question_id "
           "FROM documents d, (VALUES " + ", ".join(f"({O.q(f)})" for f in FEATS) +
           ") q(question_id)) ")
HIT_SQL = ("EXISTS (SELECT 1 FROM live l WHERE l.paper_id = r.paper_id "
           "AND l.question_id = r.question_id)")


@register("cache_hits", REQ_SQL + "SELECT r.paper_id, r.question_id FROM req r WHERE " + HIT_SQL)
def q_cache_hits(spark, sf_dir):
    return ST.cache_hits(answer_requests(spark, sf_dir), live(spark, sf_dir))


@register("cache_misses", REQ_SQL + "SELECT DISTINCT r.paper_id, r.question_id FROM req r "
          "WHERE NOT " + HIT_SQL)
def q_cache_misses(spark, sf_dir):
    return ST.cache_misses(answer_requests(spark, sf_dir), live(spark, sf_dir))


# ---------------------------------------------------------------- A1, F3, J1

PIVOT_SQL = "WITH " + O.live_cte() + ", pv AS (" + O.pivot_sql("live") + ")"
ENC_SQL = (PIVOT_SQL + ", enc AS (SELECT paper_id, " +
           ", ".join(f"{O.encode_sql(f, f)} AS {f}" for f in FEATS) + " FROM pv WHERE " +
           " AND ".join(f"{f} IS NOT NULL" for f in FEATS) + ")")


@register("pivot_answers", PIVOT_SQL + " SELECT * FROM pv")
def q_pivot_answers(spark, sf_dir):
    return FT.pivot_answers(live(spark, sf_dir), FEATS)


@register("encode_answers", ENC_SQL + " SELECT * FROM enc")
def q_encode_answers(spark, sf_dir):
    wide = FT.complete_rows(FT.pivot_answers(live(spark, sf_dir), FEATS), FEATS)
    return FT.encode_features(wide, FEATS)


@register("labelled_features", ENC_SQL + ", " + O.labels_cte() +
          " SELECT e.*, l.label FROM enc e JOIN lab l USING (paper_id)")
def q_labelled_features(spark, sf_dir):
    wide = FT.complete_rows(FT.pivot_answers(live(spark, sf_dir), FEATS), FEATS)
    return FT.labelled_features(FT.encode_features(wide, FEATS), S.labels(spark, sf_dir))


# ---------------------------------------------------------------- J2, F6, C5, C6

def _bank():
    from ..sources.questions import question_rows
    return question_rows()


BANK_VALUES = ", ".join(f"({O.q(qid)}, {O.q(text)})" for qid, text, _c, _ie in _bank())


@register("work_list",
          f"WITH {O.docs_cte()}, qb(question_id, question) AS (VALUES {BANK_VALUES}) "
          "SELECT d.paper_id, qb.question_id, 'llm-single-question:' || sha256(to_json("
          "{'title': '', 'abstract': d.text, 'question': qb.question, 'model': 'rules-v1', "
          "'mode': 'single'})) AS answer_key FROM docs d CROSS JOIN qb")
def q_work_list(spark, sf_dir):
    return X.work_list(prepare(S.papers(spark, sf_dir)), X.bank_questions())


def _reason_texts():
    bank = {qid: text for qid, text, _c, _ie in _bank()}
    return [bank[r] for r in EXCLUSION_REASONS]


def _prompts_sql():
    questions, reasons = X.bank_questions(), _reason_texts()
    listed = lambda texts: O.q("\n".join(f"{i}: {t}" for i, t in enumerate(texts)))
    rows = [(O.q(qid), "single", X.SYSTEM_SINGLE, O.q("Question: " + t)) for qid, t in questions]
    rows += [("NULL", "exclusion", X.SYSTEM_EXCLUSION,
              f"'Exclusion reasons:' || chr(10) || {listed(reasons)}")]
    rows += [(O.q(str(i)), "confirm", X.SYSTEM_DANGER, O.q("Question: " + t))
             for i, t in enumerate(reasons)]
    rows += [("NULL", "all", X.SYSTEM_ALL,
              f"'Questions:' || chr(10) || {listed([t for _q, t in questions])}")]
    values = ", ".join(f"({qid}, {O.q(mode)}, {O.q(system)}, {tail})"
                       for qid, mode, system, tail in rows)
    return (f"WITH {O.docs_cte()}, ms(question_id, mode, system, tail) AS (VALUES {values}) "
            "SELECT d.paper_id, ms.question_id, ms.mode, ms.system, 'Title: ' || chr(10) || "
            "chr(10) || 'Abstract: ' || d.text || chr(10) || chr(10) || ms.tail AS user "
            "FROM docs d CROSS JOIN ms")


@register("prompts", _prompts_sql())
def q_prompts(spark, sf_dir):
    return X.prompts(prepare(S.papers(spark, sf_dir)), X.bank_questions(), _reason_texts())


@register("extract_long",
          f"WITH {O.docs_cte()}, {O.rules_wide_cte()} SELECT paper_id, 'complete' AS status, "
          "0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, " +
          ", ".join(f"{O.encode_sql(x, x)} AS {x}" for x in O.RULE_QIDS) + " FROM rw")
def q_extract_long(spark, sf_dir):
    return X.extract_long(prepare(S.papers(spark, sf_dir)))


@register("extract_unpivot",
          f"WITH {O.docs_cte()} " + " UNION ALL ".join(
              f"SELECT paper_id, '{x}' AS question_id, {O.rule_sql(x)} AS answer FROM docs"
              for x in O.RULE_QIDS))
def q_extract_unpivot(spark, sf_dir):
    return X.extract_unpivot(prepare(S.papers(spark, sf_dir)))


# ---------------------------------------------------------------- training table, P1, P9, A2, A17, P6

def training(spark, sf_dir):
    lab = S.labels(spark, sf_dir)
    # label join first: text cleaning and rule answers run on labelled papers only
    return X.training_table(prepare(S.papers(spark, sf_dir).join(lab, "paper_id")), lab)


TT_SQL = "WITH " + O.training_ctes()


@register("training_table", TT_SQL + " SELECT * FROM tt")
def q_training_table(spark, sf_dir):
    return training(spark, sf_dir)


@register("feature_columns", TT_SQL + f" SELECT paper_id, {FEAT_SQL} FROM tt")
def q_feature_columns(spark, sf_dir):
    t = training(spark, sf_dir).withColumn("Ignored", F.lit(1)).withColumn("Extra", F.lit(2))
    return t.select("paper_id", *FT.feature_columns(t))


@register("drop_features", TT_SQL + " SELECT * EXCLUDE (I05, I07) FROM tt")
def q_drop_features(spark, sf_dir):
    return FT.drop_features(training(spark, sf_dir), ["I05", "I07"])


@register("class_dist", TT_SQL + " SELECT label, n, round(n / sum(n) OVER (), 2) AS share "
          "FROM (SELECT label, count(*) AS n FROM tt GROUP BY label)")
def q_class_dist(spark, sf_dir):
    return FT.class_dist(training(spark, sf_dir))


@register("dataset_profile", TT_SQL + f" SELECT count(*) AS n_rows, {len(FEATS) + 2} AS n_columns, "
          f"{len(FEATS)} AS n_features, {O.q(','.join(FEATS))} AS features FROM tt")
def q_dataset_profile(spark, sf_dir):
    return FT.dataset_profile(training(spark, sf_dir))


PROBE = {"I13": 1.0, "I17": 1.0, "I16": 0.0}


@register("pattern_probe", TT_SQL + " SELECT count(*) AS n, "
          "coalesce(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n_positive, "
          "coalesce(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_negative FROM tt "
          "WHERE " + " AND ".join(f"{k} = {v}" for k, v in PROBE.items()))
def q_pattern_probe(spark, sf_dir):
    return FT.pattern_probe(training(spark, sf_dir), PROBE)


# ---------------------------------------------------------------- A3, A4, A5

PAT_SQL = (TT_SQL + f", pl AS (SELECT {FEAT_SQL}, count(*) AS n, sum(label) AS n1 FROM tt "
           f"GROUP BY {FEAT_SQL}), pl2 AS (SELECT *, n - n1 AS n0, "
           "CASE WHEN n1 >= n - n1 THEN 1 ELSE 0 END AS majority_label, "
           "n1 > 0 AND n - n1 > 0 AS conflict FROM pl)")
PAT_JOIN = " AND ".join(f"t.{f} = p.{f}" for f in FEATS)


@register("conflicts_majority", PAT_SQL + " SELECT t.* FROM tt t JOIN pl2 p ON " + PAT_JOIN +
          " WHERE t.label = p.majority_label")
def q_conflicts_majority(spark, sf_dir):
    return CF.conflicts_majority(training(spark, sf_dir), FEATS)


@register("conflicts_remove", PAT_SQL + " SELECT t.* FROM tt t JOIN pl2 p ON " + PAT_JOIN +
          " WHERE NOT p.conflict")
def q_conflicts_remove(spark, sf_dir):
    return CF.conflicts_remove(training(spark, sf_dir), FEATS)


@register("conflict_report", PAT_SQL +
          " SELECT count(*) AS patterns, sum(CASE WHEN conflict THEN 1 ELSE 0 END)::BIGINT "
          "AS patterns_in_conflict, sum(CASE WHEN conflict AND n1 = n0 THEN 1 ELSE 0 END)::BIGINT "
          "AS ties, sum(CASE WHEN conflict THEN (CASE WHEN majority_label = 1 THEN n0 ELSE n1 END) "
          "ELSE 0 END)::BIGINT AS dropped_majority, sum(CASE WHEN conflict THEN n ELSE 0 END)::BIGINT "
          "AS dropped_remove, sum(n)::BIGINT AS rows FROM pl2")
def q_conflict_report(spark, sf_dir):
    return CF.conflict_report(training(spark, sf_dir), FEATS)


# ---------------------------------------------------------------- W1, W2, A6, U1, P2

SPLIT_SQL = TT_SQL + ", " + O.split_ctes()


def split_table(spark, sf_dir):
    return SP.stratified_split(training(spark, sf_dir))


def encoded_split(spark, sf_dir):
    """The labelled, encoded and split papers, computed once: a few numbers a
    paper, checkpointed before the many jobs of a fit read them."""
    return cut_model(SP.stratified_split(cut_model(training(spark, sf_dir))))


@register("stratified_split", SPLIT_SQL + " SELECT paper_id, label, split FROM sp")
def q_stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("paper_id", "label", "split")


@register("stratified_folds", SPLIT_SQL + " SELECT paper_id, label, fold FROM sp WHERE split = 'train'")
def q_stratified_folds(spark, sf_dir):
    return split_table(spark, sf_dir).where("split = 'train'").select("paper_id", "label", "fold")


@register("split_summary", SPLIT_SQL + " SELECT split, count(*) AS n, sum(label)::BIGINT AS "
          "n_positive, sum(label)::BIGINT * 100.0::DOUBLE / count(*) AS pct_positive FROM sp GROUP BY split")
def q_split_summary(spark, sf_dir):
    return SP.split_summary(split_table(spark, sf_dir))


@register("train_val_union", SPLIT_SQL + " SELECT paper_id, label, split FROM sp WHERE split = 'train' "
          "UNION ALL SELECT paper_id, label, split FROM sp WHERE split = 'val'")
def q_train_val_union(spark, sf_dir):
    return SP.train_val_union(split_table(spark, sf_dir)).select("paper_id", "label", "split")


@register("split_filter", SPLIT_SQL + f" SELECT paper_id, label, {FEAT_SQL} FROM sp WHERE split = 'test'")
def q_split_filter(spark, sf_dir):
    return SP.split_filter(split_table(spark, sf_dir), "test").select("paper_id", "label", *FEATS)


# ---------------------------------------------------------------- C3, lazy screen

@register("lazy_questions",
          f"WITH RECURSIVE {O.docs_cte()}, {O.rules_wide_cte()}, {O.fixture_ctes()}, "
          f"{O.walk_ctes()} SELECT paper_id, leaf_id, probability, path_len, path_len AS n_asked, "
          "0 AS n_hits FROM wres")
def q_lazy_questions(spark, sf_dir):
    w = lazy_walk(prepare(S.papers(spark, sf_dir)), fixture_nodes(spark), RuleProvider())
    return w.select("paper_id", "leaf_id", "probability", "path_len", "n_asked", "n_hits")


def _replay_sql():
    pick = "CASE n.feature " + " ".join(f"WHEN '{x}' THEN r.{x}" for x in FEATS) + " END"
    return (f"WITH RECURSIVE {O.live_cte()}, {O.fixture_ctes()}, pv AS ({O.pivot_sql('live')}), "
            f"rv AS (SELECT d.doc_id AS paper_id, {', '.join('pv.' + x for x in FEATS)} "
            "FROM documents d LEFT JOIN pv ON pv.paper_id = d.doc_id), "
            "walk(paper_id, node_id, path_len) AS (SELECT paper_id, 0, 0 FROM rv UNION ALL "
            f"SELECT w.paper_id, CASE {pick} WHEN 'NO' THEN n.left_id WHEN 'YES' THEN n.right_id "
            "ELSE n.unsure_id END, w.path_len + 1 FROM walk w JOIN fx n ON n.node_id = w.node_id "
            f"AND n.feature IS NOT NULL JOIN rv r ON r.paper_id = w.paper_id AND {pick} IS NOT NULL), "
            "fin AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY path_len DESC) AS rn "
            "FROM walk) SELECT f.paper_id, CASE WHEN n.feature IS NULL THEN 'done' ELSE 'unanswered' "
            "END AS status, CASE WHEN n.feature IS NULL THEN f.node_id END AS leaf_id, "
            "CASE WHEN n.feature IS NULL THEN n.p1 END AS probability, f.path_len "
            "FROM fin f JOIN fx n ON n.node_id = f.node_id WHERE f.rn = 1")


@register("replay_walk", _replay_sql())
def q_replay_walk(spark, sf_dir):
    """C3 + C7: papers walked on the live answers of the log alone; a question
    that the log does not answer stops the walk."""
    w = lazy_walk(prepare(S.papers(spark, sf_dir)), fixture_nodes(spark),
                  ReplayProvider(live(spark, sf_dir)))
    return w.select("paper_id", "status", "leaf_id", "probability", "path_len")


def _lazy_screen_sql():
    cand = " + ".join(f"(CASE WHEN {r} IN ('YES', 'UNSURE') THEN 1 ELSE 0 END)"
                      for r in EXCLUSION_REASONS)
    # confirmations: candidates up to and including the first YES
    pos_terms = []
    for i, r in enumerate(EXCLUSION_REASONS):
        before = " + ".join([f"(CASE WHEN {p} IN ('YES', 'UNSURE') THEN 1 ELSE 0 END)"
                             for p in EXCLUSION_REASONS[:i]] or ["0"])
        pos_terms.append(f"WHEN {r} = 'YES' THEN {before} + 1")
    first_pos = "CASE " + " ".join(pos_terms) + " ELSE 0 END"
    return (SCREEN_SQL + f", ls AS (SELECT paper_id, {cand} AS n_cand, {first_pos} AS pos FROM rw) "
            "SELECT s.paper_id, s.status, s.excluded_by, s.leaf_id, s.probability, "
            "coalesce(w.path_len, 0) * (CASE WHEN s.status = 'excluded' THEN 0 ELSE 1 END) AS path_len, "
            "0 AS n_hits, 1 + (CASE WHEN ls.pos > 0 THEN ls.pos ELSE ls.n_cand END) + "
            "(CASE WHEN s.status = 'excluded' THEN 0 ELSE w.path_len END) AS n_asked "
            "FROM sc s JOIN ls USING (paper_id) LEFT JOIN wres w USING (paper_id)")


@register("lazy_screen", _lazy_screen_sql())
def q_lazy_screen(spark, sf_dir):
    w = lazy_screen(prepare(S.papers(spark, sf_dir)), fixture_nodes(spark), RuleProvider())
    return w.select("paper_id", "status", "excluded_by", "leaf_id", "probability", "path_len",
                    "n_hits", "n_asked")


def _replayed_precheck_sql():
    n = len(EXCLUSION_REASONS)
    said = "CASE p.id " + " ".join(f"WHEN {i} THEN r.{x}" for i, x in enumerate(EXCLUSION_REASONS)) + " END"
    return (f"WITH {O.docs_cte()}, {O.rules_wide_cte(qids=EXCLUSION_REASONS)}, "
            "ev AS (SELECT user_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k, "
            "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), "
            "rep AS (SELECT d.doc_id AS paper_id, CASE WHEN e.event_type <> 'error' THEN "
            "list_slice([k % 9, (k + 4) % 9, (2 * k) % 10], 1, k % 4) END AS ids "
            "FROM documents d LEFT JOIN ev e ON e.user_id = d.doc_id AND e.rn = 1), "
            "pos AS (SELECT paper_id, id, min(p) AS p FROM (SELECT paper_id, unnest(ids) AS id, "
            "unnest(range(len(ids))) AS p FROM rep) GROUP BY paper_id, id), "
            "cand AS (SELECT p.paper_id, p.id, row_number() OVER (PARTITION BY p.paper_id ORDER BY p.p) "
            f"AS rk, {said} AS a FROM pos p JOIN rw r USING (paper_id)), "
            "fst AS (SELECT paper_id, min(CASE WHEN a = 'YES' THEN rk END) AS f, count(*) AS n, "
            f"bool_or(id >= {n}) AS bad FROM cand GROUP BY paper_id), "
            "st AS (SELECT rep.paper_id, CASE WHEN rep.ids IS NULL THEN 'unanswered' WHEN f.bad THEN "
            "'invalid' WHEN f.f IS NOT NULL THEN 'excluded' ELSE 'pass' END AS exclusion_status, "
            "f.f, f.n FROM rep LEFT JOIN fst f USING (paper_id)) "
            "SELECT s.paper_id, s.exclusion_status, c.id AS excluded_reason, "
            f"{O.reason_qid('c.id')} AS excluded_by, CASE WHEN s.exclusion_status = 'excluded' THEN 1 + s.f "
            "WHEN s.exclusion_status = 'pass' THEN 1 + coalesce(s.n, 0) ELSE 1 END AS n_exclusion_calls "
            "FROM st s LEFT JOIN cand c ON c.paper_id = s.paper_id AND c.rk = s.f "
            "AND s.exclusion_status = 'excluded'")


@register("replayed_precheck", _replayed_precheck_sql())
def q_replayed_precheck(spark, sf_dir):
    """C1 with an outside model: each paper's newest multi-select reply of the
    log, its reasons confirmed one by one in the reply's order."""
    log = S.selection_log(spark, sf_dir)
    newest = log.groupBy("paper_id").agg(
        F.max_by("payload", F.struct("answered_at", "event_id")).alias("payload"))
    replies = newest.select("paper_id", parse_selection("payload").alias("r")).select("paper_id", "r.*")
    d = prepare(S.papers(spark, sf_dir))
    confirms = RuleProvider().answer_long(d, F.col("text"), qids=EXCLUSION_REASONS).withColumn(
        "mode", F.lit("confirm"))
    return precheck(d, ReplayProvider(confirms, selections=replies)).select(
        "paper_id", "exclusion_status", "excluded_reason", "excluded_by", "n_exclusion_calls")


def _replayed_replies_sql():
    ans = ("CASE event_type WHEN 'click' THEN 'YES' WHEN 'purchase' THEN 'YES' "
           "WHEN 'view' THEN 'NO' WHEN 'signup' THEN 'UNSURE' END")
    names = "[" + ", ".join(O.q(x) for x in FEATS) + "]"
    return ("WITH ev AS (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k, "
            f"{ans} AS ans, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn "
            "FROM events), said AS (SELECT user_id AS paper_id, "
            f"{names}[(k % 8) + 1] AS question_id, ans AS answer FROM ev WHERE rn = 1 AND ans IS NOT NULL "
            "UNION ALL SELECT user_id, 'I05', 'UNSURE' FROM ev WHERE rn = 1 AND ans IS NOT NULL "
            "AND k % 2 = 0), one AS (SELECT paper_id, question_id, min(answer) AS answer FROM said "
            "GROUP BY paper_id, question_id HAVING min(answer) = max(answer)), "
            f"qs AS (SELECT unnest({names}) AS question_id) "
            "SELECT d.doc_id AS paper_id, qs.question_id, one.answer FROM documents d CROSS JOIN qs "
            "LEFT JOIN one ON one.paper_id = d.doc_id AND one.question_id = qs.question_id")


@register("replayed_replies", _replayed_replies_sql())
def q_replayed_replies(spark, sf_dir):
    """C6 with an outside model: each paper's newest all-at-once reply of the log."""
    newest = S.reply_log(spark, sf_dir).groupBy("paper_id").agg(
        F.max_by("payload", F.struct("answered_at", "event_id")).alias("payload"))
    papers = S.papers(spark, sf_dir).select("paper_id", F.lit("").alias("title_clean"),
                                            F.col("abstract").alias("abstract_clean"))
    return X.extract_unpivot(papers, ReplayProvider(None, replies=newest), FEATS)


# ================================================================ batch 3: training
from ..operators import resample as RS  # noqa: E402
from ..operators import train as TR  # noqa: E402
from ..operators.tree import nodes_by_support  # noqa: E402
from . import training as TRN  # noqa: E402

DEFAULT_TREE = {"criterion": "gini", "max_depth": None, "min_samples_split": 2,
                "min_samples_leaf": 1, "max_features": None}


@register("class_weights", TT_SQL + " SELECT label, sum(n) OVER () / (count(*) OVER () * n) "
          "AS class_weight FROM (SELECT label, count(*) AS n FROM tt GROUP BY label)")
def q_class_weights(spark, sf_dir):
    return TR.class_weights(training(spark, sf_dir))


@register("smoten", TT_SQL + ", " + O.smoten_sql() + " SELECT * FROM syn")
def q_smoten(spark, sf_dir):
    return RS.smoten(TR.patterns(training(spark, sf_dir), FEATS), FEATS)


@register("vdm_neighbours", TT_SQL + ", " + O.smoten_sql() +
          " SELECT a_code, b_code, round(dist, 9) AS dist, take FROM pr3 WHERE take > 0")
def q_vdm_neighbours(spark, sf_dir):
    nb = RS.vdm_neighbours(TR.patterns(training(spark, sf_dir), FEATS), FEATS)
    return nb.select("a_code", "b_code", F.round("dist", 9).alias("dist"), "take")


@register("oversample", TT_SQL + ", " + O.smoten_sql() +
          f" SELECT {FEAT_SQL}, count(*) AS n, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS w0, "
          f"sum(label)::DOUBLE AS w1, false AS is_synthetic FROM tt GROUP BY {FEAT_SQL} "
          "UNION ALL SELECT * FROM syn")
def q_oversample(spark, sf_dir):
    return RS.oversample(TR.patterns(training(spark, sf_dir), FEATS), FEATS)


@register("smote", None)
def q_smote(spark, sf_dir):
    return RS.smote_rows(training(spark, sf_dir), FEATS)


@register("fit_tree_depth2", TT_SQL + ", " + O.depth2_tree_sql() +
          " SELECT node_id, feature, n0, n1 FROM nodes2")
def q_fit_tree_depth2(spark, sf_dir):
    t = training(spark, sf_dir)
    cfg = TR.configs_df(spark, [{"run_id": "d2", **DEFAULT_TREE, "max_depth": 2}])
    nodes = TR.fit_trees(TR.patterns(t, FEATS).withColumn("run_id", F.lit("d2")), cfg, FEATS)
    return nodes.select(F.col("node_id").cast("int").alias("node_id"), "feature", "n0", "n1")


# the same depth-2 tree under every operator that reads a node table: its SQL
# exists, so each has an exact twin
def depth2_tree(spark, sf_dir):
    t = training(spark, sf_dir)
    cfg = TR.configs_df(spark, [{"run_id": "d2", **DEFAULT_TREE, "max_depth": 2}])
    return cut_model(TR.fit_trees(TR.patterns(t, FEATS).withColumn("run_id", F.lit("d2")), cfg,
                                  FEATS)), t


D2_SQL = TT_SQL + ", " + O.depth2_tree_sql() + (
    ", d2 AS (SELECT node_id, feature, n0, n1, CASE WHEN node_id = 0 THEN 0 WHEN node_id < 3 "
    "THEN 1 ELSE 2 END AS depth FROM nodes2), lv AS (SELECT * FROM d2 WHERE feature IS NULL), "
    "anc AS (SELECT l.*, 0 AS anc_id, CASE WHEN l.node_id IN (1, 3, 4) THEN 'left' ELSE 'right' "
    "END AS side FROM lv l WHERE l.node_id > 0 UNION ALL SELECT l.*, (l.node_id - 1) // 2, "
    "CASE WHEN l.node_id % 2 = 1 THEN 'left' ELSE 'right' END FROM lv l WHERE l.node_id > 2), "
    "sl AS (SELECT anc_id AS node_id, side, "
    "sum(CASE WHEN n1 > n0 THEN 0 ELSE n0 + n1 END)::BIGINT AS class0, "
    "sum(CASE WHEN n1 > n0 THEN n0 + n1 ELSE 0 END)::BIGINT AS class1 FROM anc GROUP BY 1, 2)")
D2_VALUE = "CASE d.feature " + " ".join(f"WHEN '{f}' THEN t.{f}" for f in FEATS) + " END"
D2_ROWS = D2_SQL + (
    f", w1 AS (SELECT t.*, CASE WHEN d.feature IS NULL THEN 0 WHEN {D2_VALUE} <= 0.5 THEN 1 "
    "ELSE 2 END AS at1 FROM tt t JOIN d2 d ON d.node_id = 0), "
    f"w2 AS (SELECT t.*, CASE WHEN d.feature IS NULL THEN t.at1 WHEN {D2_VALUE} <= 0.5 "
    "THEN 2 * t.at1 + 1 ELSE 2 * t.at1 + 2 END AS leaf_id FROM w1 t JOIN d2 d ON d.node_id = t.at1), "
    "pr AS (SELECT w2.paper_id, w2.label, w2.leaf_id, l.n1 / (l.n0 + l.n1) AS probability "
    "FROM w2 JOIN d2 l ON l.node_id = w2.leaf_id)")


@register("leaf_depth_depth2", D2_SQL + " SELECT node_id, depth FROM lv")
def q_leaf_depth_depth2(spark, sf_dir):
    return XP.leaf_depth(depth2_tree(spark, sf_dir)[0]).select("node_id", "depth")


@register("mean_leaf_depth", D2_SQL + " SELECT round(avg(depth), 9) AS mean_leaf_depth, "
          "count(*) AS n_leaves FROM lv")
def q_mean_leaf_depth(spark, sf_dir):
    return XP.mean_leaf_depth(depth2_tree(spark, sf_dir)[0]).select("mean_leaf_depth", "n_leaves")


@register("subtree_leaf_counts_depth2", D2_SQL + " SELECT * FROM sl")
def q_subtree_leaf_counts_depth2(spark, sf_dir):
    return XP.subtree_leaf_counts(depth2_tree(spark, sf_dir)[0], "n_samples").select(
        "node_id", "side", "class0", "class1")


@register("critical_nodes_depth2", D2_SQL + ", rk AS (SELECT node_id, "
          "max(CASE WHEN side = 'left' THEN class0 / (class0 + class1) END) AS risk_if_0, "
          "max(CASE WHEN side = 'right' THEN class0 / (class0 + class1) END) AS risk_if_1 "
          "FROM sl GROUP BY node_id) SELECT node_id, feature, risk_if_0, risk_if_1, "
          "risk_if_0 > 0.9 OR risk_if_1 > 0.9 AS is_critical FROM rk JOIN d2 USING (node_id)")
def q_critical_nodes_depth2(spark, sf_dir):
    return XP.critical_nodes(depth2_tree(spark, sf_dir)[0], 0.9, "n_samples").select(
        "node_id", "feature", "risk_if_0", "risk_if_1", "is_critical")


@register("nodes_by_support_depth2", D2_SQL + " SELECT node_id, feature, n0, n1, "
          "n1 / (n0 + n1) AS p1 FROM d2 WHERE n0 + n1 = (SELECT max(n0 + n1) FROM lv)")
def q_nodes_by_support_depth2(spark, sf_dir):
    nodes = depth2_tree(spark, sf_dir)[0]
    top = nodes.where("feature IS NULL").agg(F.max(F.col("n0") + F.col("n1"))).first()[0]
    return nodes_by_support(nodes, top).select("node_id", "feature", "n0", "n1", "p1")


@register("predict_proba_depth2", D2_ROWS + " SELECT * FROM pr")
def q_predict_proba_depth2(spark, sf_dir):
    nodes, t = depth2_tree(spark, sf_dir)
    return TRN.score_rows(t, nodes, FEATS).select("paper_id", "label", "leaf_id", "probability")


@register("cv_scores_depth2", D2_ROWS + ", cm AS (SELECT label, "
          "sum(CASE WHEN probability >= 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, "
          "sum(CASE WHEN probability < 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, "
          "sum(CASE WHEN probability >= 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, "
          "sum(CASE WHEN probability < 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn "
          "FROM pr GROUP BY label) SELECT sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, "
          "sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn FROM cm")
def q_cv_scores_depth2(spark, sf_dir):
    nodes, t = depth2_tree(spark, sf_dir)
    pats = TR.patterns(t, FEATS).withColumn("run_id", F.lit("d2")).withColumn("tree_id", F.lit(0))
    return TR.cv_scores(TR.predict_patterns(pats, nodes, FEATS), ["run_id"]).select(
        "tp", "fn", "fp", "tn")


@register("trained_sweep_depth2", D2_ROWS + ", th AS (SELECT 0.05::DOUBLE + i::DOUBLE * 0.05::DOUBLE AS threshold FROM range(10) r(i)) "
          "SELECT threshold, "
          "sum(CASE WHEN probability >= threshold AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, "
          "sum(CASE WHEN probability >= threshold AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp "
          "FROM pr, th GROUP BY threshold")
def q_trained_sweep_depth2(spark, sf_dir):
    nodes, t = depth2_tree(spark, sf_dir)
    return M.threshold_sweep(TRN.score_rows(t, nodes, FEATS)).select("threshold", "tp", "fp")


def final_tree(spark, sf_dir):
    """Train side (train + val) cleaned by majority, SMOTEN, default tree."""
    sp = encoded_split(spark, sf_dir)
    tr = CF.conflicts_majority(SP.train_val_union(sp), FEATS)
    return TRN.fit_final(tr, FEATS, DEFAULT_TREE), sp


@register("fit_tree", None)
def q_fit_tree(spark, sf_dir):
    nodes, _ = final_tree(spark, sf_dir)
    return nodes


def scored_test(spark, sf_dir):
    nodes, sp = final_tree(spark, sf_dir)
    nodes = cut_model(nodes)
    test = SP.split_filter(sp, "test")
    return TRN.score_rows(test, nodes, FEATS), nodes


def cut_model(nodes):
    from ..config import cut_lineage
    return cut_lineage(nodes)


@register("predict_proba", None)
def q_predict_proba(spark, sf_dir):
    s, _ = scored_test(spark, sf_dir)
    return s.select("paper_id", "label", "leaf_id", "probability")


@register("trained_sweep", None)
def q_trained_sweep(spark, sf_dir):
    s, _ = scored_test(spark, sf_dir)
    return M.threshold_sweep(s)


@register("trained_purity", None)
def q_trained_purity(spark, sf_dir):
    s, nodes = scored_test(spark, sf_dir)
    leaf = nodes.select(F.col("node_id").alias("leaf_id"), F.col("impurity").alias("leaf_impurity"),
                        (F.col("n0") + F.col("n1")).alias("leaf_support"))
    from ..config import bounded_broadcast
    return M.purity_metrics(s.join(bounded_broadcast(leaf), "leaf_id"))


#: The searched grid of the flow below: M8's, whole.
FLOW_GRID = TRN.TREE_GRID


@register("trained_screen", None)
def q_trained_screen(spark, sf_dir):
    """Search, refit, write the model, read it back, screen every paper."""
    from ..config import scratch_path
    from ..sources.sinks import read_model, write_model
    _config, nodes = TRN.search_and_fit(encoded_split(spark, sf_dir), FEATS, FLOW_GRID)
    path = scratch_path(spark, "trained-model")
    write_model(nodes, path)
    model = read_model(spark, path, "final")
    return screen(S.papers(spark, sf_dir), model).select(
        "paper_id", "status", "excluded_by", "leaf_id", "probability", "prediction")


@register("node_roundtrip", None)
def q_node_roundtrip(spark, sf_dir):
    from ..sources.sinks import read_model, write_model
    from ..config import scratch_path
    nodes, _ = final_tree(spark, sf_dir)
    path = scratch_path(spark, "model")
    write_model(nodes, path)
    return read_model(spark, path, "final")


@register("nodes_by_support", None)
def q_nodes_by_support(spark, sf_dir):
    nodes, _ = final_tree(spark, sf_dir)
    nodes = cut_model(nodes)
    top = nodes.where("feature IS NULL").agg(F.max(F.col("n0") + F.col("n1"))).first()[0]
    return nodes_by_support(nodes, top)


@register("grid_search", None)
def q_grid_search(spark, sf_dir):
    sp = encoded_split(spark, sf_dir).where("split = 'train'")
    return TRN.grid_search(sp, FEATS)


@register("random_search", None)
def q_random_search(spark, sf_dir):
    sp = encoded_split(spark, sf_dir).where("split = 'train'")
    return TRN.forest_search(sp, FEATS, TRN.random_search_configs())


# ================================================================ batch 4: explain, streaming
from ..operators import explain as XP  # noqa: E402


@register("mutual_info", TT_SQL + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS x, label AS y FROM tt" for f in FEATS) +
    "), c AS (SELECT feature, x, y, count(*)::DOUBLE AS nxy FROM u GROUP BY feature, x, y), "
    "c2 AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, "
    "sum(nxy) OVER (PARTITION BY feature, x) AS nx, sum(nxy) OVER (PARTITION BY feature, y) AS ny FROM c) "
    "SELECT feature, round(sum((nxy / n) * ln((nxy * n) / (nx * ny))), 12) AS mutual_info "
    "FROM c2 GROUP BY feature")
def q_mutual_info(spark, sf_dir):
    return XP.mutual_info(training(spark, sf_dir), FEATS)


@register("leaf_depth", None)
def q_leaf_depth(spark, sf_dir):
    nodes, _ = final_tree(spark, sf_dir)
    return XP.leaf_depth(nodes)


@register("subtree_leaf_counts", None)
def q_subtree_leaf_counts(spark, sf_dir):
    nodes, _ = final_tree(spark, sf_dir)
    return XP.subtree_leaf_counts(cut_model(nodes), "n_samples")


@register("critical_nodes", None)
def q_critical_nodes(spark, sf_dir):
    nodes, _ = final_tree(spark, sf_dir)
    return XP.critical_nodes(cut_model(nodes), 0.9, "n_samples")


@register("shap_values", None)
def q_shap_values(spark, sf_dir):
    nodes, sp = final_tree(spark, sf_dir)
    nodes = cut_model(nodes)
    train = sp.where("split = 'train'")
    return XP.shap_summary(train, XP.shap_values(train, nodes, FEATS), FEATS)


@register("stream_screen", SCREEN_SQL + " SELECT * FROM sc")
def q_stream_screen(spark, sf_dir):
    from ..streaming.stream import stream_screen
    out = stream_screen(spark, sf_dir, fixture_nodes(spark))
    return spark.read.parquet(out).drop("batch_id")


@register("stream_dedupe", "WITH " + O.log_cte() + " SELECT DISTINCT paper_id, question_id FROM alog WHERE valid")
def q_stream_dedupe(spark, sf_dir):
    from ..streaming.stream import stream_dedupe
    out = stream_dedupe(spark, sf_dir)
    return spark.read.parquet(out).select("paper_id", "question_id")


@register("ablation", None)
def q_ablation(spark, sf_dir):
    """Questions ranked by the fold recall that their removal costs."""
    return TRN.ablation(encoded_split(spark, sf_dir).where("split = 'train'"), FEATS, DEFAULT_TREE)


@register("adopted_leaf_depth", D2_SQL + " SELECT node_id, depth FROM lv")
def q_adopted_leaf_depth(spark, sf_dir):
    """The depth-2 tree under foreign node ids and without depth, adopted."""
    from ..sources.models import adopt
    nodes = depth2_tree(spark, sf_dir)[0].drop("depth")
    foreign = {c: F.when(F.col(c) >= 0, (F.col(c) * 37 + 11) % 101).otherwise(F.col(c))
               for c in ("node_id", "left_id", "right_id")}
    return XP.leaf_depth(adopt(nodes.withColumns(foreign))).select("node_id", "depth")


#: TTL of the registered memo stream: short enough for answers to expire.
MEMO_TTL_SECONDS = 5 * 24 * 3600


def _memo_sql():
    ttl = MEMO_TTL_SECONDS * 1000
    key, cols = "paper_id, question_id", "paper_id, question_id, rn, ms, answer, evidence"
    return (f"WITH RECURSIVE {O.log_cte()}, ml AS (SELECT *, epoch_ms(answered_at) AS ms FROM alog), "
            f"od AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ms, event_id) AS rn FROM ml), "
            # the writes: the first valid reply, then the first one at least a TTL later
            f"w AS (SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rn) AS k "
            f"FROM od WHERE valid) f WHERE k = 1 UNION ALL SELECT {cols} FROM (SELECT o.paper_id, "
            "o.question_id, o.rn, o.ms, o.answer, o.evidence, row_number() OVER (PARTITION BY o.paper_id, "
            "o.question_id ORDER BY o.rn) AS k FROM w JOIN od o ON o.paper_id = w.paper_id AND "
            f"o.question_id = w.question_id AND o.valid AND o.ms >= w.ms + {ttl}) n WHERE k = 1), "
            "kn AS (SELECT o.event_id, o.paper_id, o.question_id, o.answer, o.evidence, o.ms, "
            "w.answer AS wa, w.evidence AS we, w.ms AS wms, row_number() OVER (PARTITION BY o.event_id "
            "ORDER BY w.rn DESC) AS k FROM od o LEFT JOIN w ON o.paper_id = w.paper_id AND "
            "o.question_id = w.question_id AND w.rn < o.rn) "
            "SELECT paper_id, question_id, event_id, "
            f"CASE WHEN ms - wms < {ttl} THEN 'hit' WHEN ms - wms < {2 * ttl} THEN 'expired' "
            "ELSE 'miss' END AS outcome, "
            f"CASE WHEN ms - wms < {ttl} THEN wa ELSE answer END AS answer, "
            f"CASE WHEN ms - wms < {ttl} THEN we ELSE evidence END AS evidence FROM kn WHERE k = 1")


@register("stream_memo", _memo_sql())
def q_stream_memo(spark, sf_dir):
    """T2 + J3: every event as a request, answered from the memo or asked."""
    from ..streaming.memo import stream_memo
    return spark.read.parquet(stream_memo(spark, sf_dir, MEMO_TTL_SECONDS))


# ---------------------------------------------------------------- M6, A14 (one forest)
FOREST_CONFIG = {"config_id": 0, "criterion": "gini", "max_depth": None, "min_samples_split": 2,
                 "min_samples_leaf": 2, "max_features": "sqrt", "n_estimators": 100,
                 "bootstrap": True}


def fitted_forest(spark, sf_dir):
    """Train side (train + val), balanced class weights, bootstrap: 100 trees."""
    sp = encoded_split(spark, sf_dir)
    tr = SP.train_val_union(sp)
    pats = TR.patterns(tr, FEATS).withColumn("run_id", F.lit("forest"))
    tot = pats.agg(F.sum("w0").alias("N0"), F.sum("w1").alias("N1"))
    # bootstrap draws of the unweighted rows, then 'balanced' class weights
    pats = TRN.poisson_weights(pats, FOREST_CONFIG["n_estimators"], bootstrap=True,
                               pattern_cols=FEATS)
    pats = (pats.crossJoin(F.broadcast(tot))  # one-row totals (a scalar)
            .withColumn("w0", F.col("w0") * (F.col("N0") + F.col("N1")) / (2.0 * F.col("N0")))
            .withColumn("w1", F.col("w1") * (F.col("N0") + F.col("N1")) / (2.0 * F.col("N1")))
            .drop("N0", "N1"))
    cfg = TR.configs_df(spark, [{**FOREST_CONFIG, "run_id": "forest"}])
    return cut_model(TR.fit_trees(pats, cfg, FEATS)), sp


@register("fit_forest", None)
def q_fit_forest(spark, sf_dir):
    nodes, _ = fitted_forest(spark, sf_dir)
    return nodes


@register("forest_proba", None)
def q_forest_proba(spark, sf_dir):
    nodes, sp = fitted_forest(spark, sf_dir)
    test = SP.split_filter(sp, "test")
    pats = test.select(*FEATS).distinct().withColumn("run_id", F.lit("forest"))
    trees = nodes.select("run_id", "tree_id").distinct()
    pred = TR.predict_patterns(pats.join(trees, "run_id"), nodes, FEATS)
    vote = TRN.forest_proba(pred, FEATS)
    from ..config import bounded_broadcast
    return test.join(bounded_broadcast(vote), FEATS).select("paper_id", "label", "probability")


@register("smote_forest_sweep", None)
def q_smote_forest_sweep(spark, sf_dir):
    """Search over 40 forests, the best one refitted on SMOTE rows, swept."""
    return TRN.smote_forest_sweep(encoded_split(spark, sf_dir), FEATS, TRN.random_search_configs())


# ---------------------------------------------------------------- P8
@register("eval_sample", SCORED_SQL + " SELECT paper_id, probability, prediction, y AS label FROM st")
def q_eval_sample(spark, sf_dir):
    d = scored_labelled(spark, sf_dir).select("paper_id", "probability", "prediction", "label")
    return M.eval_sample(d)
