"""DuckDB SQL twins of the Spark plans (the correctness oracle).

These strings are built from the same fixed values (rules, fixture tree,
reasons) as the Spark side, so a change of a fixed value changes both.
They run on the driver's pre-registered views.
"""

from __future__ import annotations

from ..constants import EXCLUSION_REASONS, FEATURE_ORDER, FIXTURE_TREE, RULES
from ..functions.text import sql_clean_text, sql_html_to_text

RULE_QIDS = list(RULES)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rule_sql(qid: str, txt: str = "text") -> str:
    y, u = RULES[qid]
    return (f"CASE WHEN regexp_matches({txt}, {q(y)}) THEN 'YES' "
            f"WHEN regexp_matches({txt}, {q(u)}) THEN 'UNSURE' ELSE 'NO' END")


def evidence_sql(qid: str, txt: str = "text") -> str:
    y, u = RULES[qid]
    return (f"CASE WHEN regexp_matches({txt}, {q(y)}) THEN regexp_extract({txt}, {q(y)}, 0) "
            f"WHEN regexp_matches({txt}, {q(u)}) THEN regexp_extract({txt}, {q(u)}, 0) "
            f"ELSE '' END")


def docs_cte(name: str = "docs") -> str:
    """papers from documents, cleaned; title is '' so text = abstract."""
    return (f"{name} AS (SELECT doc_id AS paper_id, {sql_clean_text('text')} AS text "
            f"FROM documents)")


def pages_cte(name: str = "pgs") -> str:
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"
    t = sql_clean_text(title)
    a = sql_clean_text("html")
    return (f"{name}0 AS (SELECT page_id AS paper_id, {t} AS title_clean, {a} AS abstract_clean "
            f"FROM pages), "
            f"{name} AS (SELECT paper_id, CASE WHEN title_clean = '' THEN abstract_clean "
            f"WHEN abstract_clean = '' THEN title_clean "
            f"ELSE title_clean || chr(10) || abstract_clean END AS text FROM {name}0)")


def rules_wide_cte(src: str = "docs", name: str = "rw", qids=None) -> str:
    qids = qids or RULE_QIDS
    cols = ", ".join(f"{rule_sql(x)} AS {x}" for x in qids)
    return f"{name} AS (SELECT paper_id, text, {cols} FROM {src})"


def rules_long_sql(src: str = "docs", qids=None) -> str:
    qids = qids or RULE_QIDS
    parts = [f"SELECT paper_id, '{x}' AS question_id, {rule_sql(x)} AS answer, "
             f"{evidence_sql(x)} AS evidence FROM {src}" for x in qids]
    return " UNION ALL ".join(parts)


def fixture_ctes() -> str:
    vals = ", ".join(
        f"({n}, {q(f) if f else 'NULL'}, {l}, {r}, {float(a)}::DOUBLE, {float(b)}::DOUBLE)"
        for n, f, l, r, a, b in FIXTURE_TREE)
    return (f"fx0(node_id, feature, left_id, right_id, n0, n1) AS (VALUES {vals}), "
            "fx1 AS (SELECT n.node_id, n.feature, n.left_id, n.right_id, n.n0, n.n1, "
            "n.n1 / (n.n0 + n.n1) AS p1, l.n1 / (l.n0 + l.n1) AS left_p1, "
            "r.n1 / (r.n0 + r.n1) AS right_p1 FROM fx0 n "
            "LEFT JOIN fx0 l ON l.node_id = n.left_id LEFT JOIN fx0 r ON r.node_id = n.right_id), "
            "fx AS (SELECT *, CASE WHEN feature IS NULL THEN NULL "
            "WHEN left_p1 > right_p1 THEN left_id ELSE right_id END AS unsure_id, "
            "1 - (n0/(n0+n1))*(n0/(n0+n1)) - (n1/(n0+n1))*(n1/(n0+n1)) AS impurity FROM fx1)")


def walk_ctes(rw: str = "rw", qids=None) -> str:
    """Recursive walk of every paper down the fixture tree (three-valued)."""
    qids = qids or RULE_QIDS
    pick = "CASE n.feature " + " ".join(f"WHEN '{x}' THEN r.{x}" for x in qids) + " END"
    return (
        f"walk(paper_id, node_id, path_len, step_q, step_a, step_score, step_node) AS ("
        f"SELECT paper_id, 0, 0, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::INTEGER FROM {rw} "
        f"UNION ALL SELECT w.paper_id, "
        f"CASE {pick} WHEN 'NO' THEN n.left_id WHEN 'YES' THEN n.right_id ELSE n.unsure_id END, "
        f"w.path_len + 1, n.feature, {pick}, "
        f"CASE {pick} WHEN 'NO' THEN n.left_p1 WHEN 'YES' THEN n.right_p1 "
        f"ELSE (CASE WHEN n.unsure_id = n.left_id THEN n.left_p1 ELSE n.right_p1 END) END, "
        f"n.node_id "
        f"FROM walk w JOIN fx n ON n.node_id = w.node_id AND n.feature IS NOT NULL "
        f"JOIN {rw} r ON r.paper_id = w.paper_id), "
        "wres AS (SELECT w.paper_id, w.node_id AS leaf_id, n.p1 AS probability, w.path_len "
        "FROM walk w JOIN fx n ON n.node_id = w.node_id WHERE n.feature IS NULL)")


def exclusion_cte(rw: str = "rw", name: str = "ex") -> str:
    first = "CASE " + " ".join(f"WHEN {x} = 'YES' THEN {i}" for i, x in enumerate(EXCLUSION_REASONS)) + " END"
    return f"{name} AS (SELECT paper_id, {first} AS excluded_reason FROM {rw})"


def reason_qid(expr: str) -> str:
    return "CASE " + expr + " " + " ".join(
        f"WHEN {i} THEN '{x}'" for i, x in enumerate(EXCLUSION_REASONS)) + " END"


def screen_ctes(src_cte: str | None = None) -> str:
    """docs -> rules -> exclusion -> walk -> sc(paper_id, status, excluded_by,
    leaf_id, probability, prediction, n_steps)."""
    src = src_cte or docs_cte()
    return (
        f"{src}, {rules_wide_cte()}, {fixture_ctes()}, {walk_ctes()}, {exclusion_cte()}, "
        "sc AS (SELECT r.paper_id, "
        "CASE WHEN e.excluded_reason IS NOT NULL THEN 'excluded' ELSE 'done' END AS status, "
        f"{reason_qid('e.excluded_reason')} AS excluded_by, "
        "CASE WHEN e.excluded_reason IS NOT NULL THEN NULL ELSE w.leaf_id END AS leaf_id, "
        "CASE WHEN e.excluded_reason IS NOT NULL THEN 0.0::DOUBLE ELSE w.probability END AS probability, "
        "CASE WHEN (CASE WHEN e.excluded_reason IS NOT NULL THEN 0.0::DOUBLE ELSE w.probability END) >= 0.5 "
        "THEN 1 ELSE 0 END AS prediction, "
        "CASE WHEN e.excluded_reason IS NOT NULL THEN 1 ELSE w.path_len END AS n_steps "
        "FROM rw r JOIN ex e USING (paper_id) JOIN wres w USING (paper_id))")


def labels_cte(name: str = "lab", label: str = "toxic") -> str:
    return f"{name} AS (SELECT doc_id AS paper_id, {label}::INTEGER AS label FROM labels)"


def confusion_sql(y: str = "y", p: str = "pred", w: str = "1") -> str:
    return (f"SUM(CASE WHEN {y} = 1 AND {p} = 1 THEN {w} ELSE 0 END)::BIGINT AS tp, "
            f"SUM(CASE WHEN {y} = 1 AND {p} = 0 THEN {w} ELSE 0 END)::BIGINT AS fn, "
            f"SUM(CASE WHEN {y} = 0 AND {p} = 1 THEN {w} ELSE 0 END)::BIGINT AS fp, "
            f"SUM(CASE WHEN {y} = 0 AND {p} = 0 THEN {w} ELSE 0 END)::BIGINT AS tn")


METRICS_SQL = (
    "CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall, "
    "CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, "
    "CASE WHEN tp + tn + fp + fn = 0 THEN NULL::DOUBLE ELSE (tp + tn)::DOUBLE / (tp + tn + fp + fn) END AS accuracy, "
    "CASE WHEN tn + fp = 0 THEN NULL::DOUBLE ELSE tn::DOUBLE / (tn + fp) END AS specificity")

THRESHOLDS_CTE = ("th AS (SELECT i::INTEGER AS i, 0.05::DOUBLE + i::DOUBLE * 0.05::DOUBLE AS threshold "
                  "FROM range(10) t(i))")


def sweep_ctes(scored: str = "st", name: str = "sw") -> str:
    """``scored`` has columns p (probability) and y (label)."""
    return (f"{THRESHOLDS_CTE}, {name}0 AS (SELECT i, threshold, "
            f"{confusion_sql('y', 'CASE WHEN p >= threshold THEN 1 ELSE 0 END')} "
            f"FROM {scored} CROSS JOIN th GROUP BY i, threshold), "
            f"{name} AS (SELECT i, threshold, tp, fn, fp, tn, {METRICS_SQL} FROM {name}0)")


FEATURES = FEATURE_ORDER
__all__ = ["docs_cte", "pages_cte", "rules_wide_cte", "rules_long_sql", "fixture_ctes",
           "walk_ctes", "screen_ctes", "labels_cte", "confusion_sql", "METRICS_SQL",
           "sweep_ctes", "sql_html_to_text", "exclusion_cte", "reason_qid", "q"]


# ---------------------------------------------------------------- batch 2

def encode_sql(col: str, qid: str, policy: str = "include_aware") -> str:
    unsure = {"include_aware": "1.0" if qid.startswith("I") else "0.0",
              "unsure_one": "1.0", "unsure_half": "0.5"}[policy]
    return (f"(CASE {col} WHEN 'NO' THEN 0.0 WHEN 'YES' THEN 1.0 "
            f"WHEN 'UNSURE' THEN {unsure} END)::DOUBLE")


def training_ctes(features=None, name: str = "tt") -> str:
    """docs -> rules (features) -> encode -> join labels: tt(paper_id, label, features)."""
    features = features or FEATURE_ORDER
    enc = ", ".join(f"{encode_sql(f, f)} AS {f}" for f in features)
    return (f"{docs_cte()}, {rules_wide_cte(qids=features)}, {labels_cte()}, "
            f"{name} AS (SELECT r.paper_id, l.label, {enc} FROM rw r JOIN lab l USING (paper_id))")


def log_cte(name: str = "alog") -> str:
    qarr = "[" + ", ".join(q(x) for x in FEATURE_ORDER) + "]"
    n = len(FEATURE_ORDER)
    ans = ("CASE event_type WHEN 'click' THEN 'YES' WHEN 'purchase' THEN 'YES' "
           "WHEN 'view' THEN 'NO' WHEN 'signup' THEN 'UNSURE' END")
    return (f"{name} AS (SELECT event_id, user_id AS paper_id, "
            f"{qarr}[((json_extract_string(props, '$.k')::BIGINT % {n} + {n}) % {n}) + 1] AS question_id, "
            f"ts AS answered_at, {ans} AS answer, "
            f"CASE WHEN {ans} IS NULL THEN NULL ELSE 'event ' || event_id::VARCHAR END AS evidence, "
            f"CASE WHEN {ans} IS NULL THEN NULL ELSE floor(value)::BIGINT END AS prompt_tokens, "
            f"CASE WHEN {ans} IS NULL THEN NULL ELSE 0::BIGINT END AS completion_tokens, "
            f"{ans} IS NOT NULL AS valid FROM events)")


def live_cte(name: str = "live") -> str:
    return (f"{log_cte()}, lw AS (SELECT *, row_number() OVER (PARTITION BY paper_id, question_id "
            "ORDER BY answered_at DESC, event_id DESC) AS rn FROM alog), "
            f"{name} AS (SELECT * FROM lw WHERE rn = 1 AND valid AND answered_at > "
            "(SELECT max(ts) FROM events) + INTERVAL 15 DAY - INTERVAL 30 DAY)")


def pivot_sql(src: str, questions=None) -> str:
    questions = questions or FEATURE_ORDER
    cols = ", ".join(f"max(CASE WHEN question_id = {q(x)} THEN answer END) AS {x}" for x in questions)
    return f"SELECT paper_id, {cols} FROM {src} GROUP BY paper_id"


def rank_sql(label: str = "label", id_col: str = "paper_id", seed: int = 42) -> str:
    return (f"row_number() OVER (PARTITION BY {label} ORDER BY "
            f"md5('{seed}' || '-' || {id_col}::VARCHAR), {id_col}) - 1")


def split_ctes(src: str = "tt", name: str = "sp", test_size: float = 0.2,
               val_size: float = 0.25, n_folds: int = 5) -> str:
    return (f"{name}0 AS (SELECT *, {rank_sql()} AS rk, count(*) OVER (PARTITION BY label) AS nc "
            f"FROM {src}), "
            f"{name}1 AS (SELECT *, ceil(nc * {test_size})::BIGINT AS nt FROM {name}0), "
            f"{name}2 AS (SELECT *, ceil((nc - nt) * {val_size})::BIGINT AS nv FROM {name}1), "
            f"{name} AS (SELECT * EXCLUDE (rk, nc, nt, nv), "
            "CASE WHEN rk < nt THEN 'test' WHEN rk < nt + nv THEN 'val' ELSE 'train' END AS split, "
            f"CASE WHEN rk >= nt + nv THEN ((rk - nt - nv) % {n_folds})::INTEGER END AS fold "
            f"FROM {name}2)")


# ---------------------------------------------------------------- batch 3

def smoten_sql(src: str = "tt", k: int = 5, features=None) -> str:
    """All-pairs (oracle only) SMOTEN on the patterns of ``src`` -> CTE syn."""
    fs = features or FEATURE_ORDER
    code_a = " + ".join(f"a.{f}::BIGINT * {1 << i}" for i, f in enumerate(fs))
    code_b = " + ".join(f"b.{f}::BIGINT * {1 << i}" for i, f in enumerate(fs))
    costs = ", ".join(
        f"CASE WHEN avg(CASE WHEN {f} = 0 THEN label END) IS NULL OR "
        f"avg(CASE WHEN {f} = 1 THEN label END) IS NULL THEN 0.0::DOUBLE ELSE "
        f"pow(2.0 * abs(avg(CASE WHEN {f} = 0 THEN label END) - "
        f"avg(CASE WHEN {f} = 1 THEN label END)), 2.0) END AS c_{f}" for f in fs)
    dist = " + ".join(f"(CASE WHEN a.{f} <> b.{f} THEN c.c_{f} ELSE 0.0 END)" for f in fs)
    same = " AND ".join(f"a.{f} = b.{f}" for f in fs)
    fcols = ", ".join(fs)
    ones = ", ".join(f"sum(take * b_{f}) AS ones_{f}" for f in fs)
    syn = ", ".join(f"CASE WHEN ones_{f} > kk - ones_{f} THEN 1.0 ELSE 0.0 END::DOUBLE AS {f}"
                    for f in fs)
    bcols = ", ".join(f"b.{f} AS b_{f}" for f in fs)
    acols = ", ".join(f"a.{f} AS a_{f}" for f in fs)
    agrp = ", ".join(f"a_{f}" for f in fs)
    return (
        f"ct AS (SELECT sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS N0, "
        f"sum(label)::DOUBLE AS N1 FROM {src}), "
        "ct2 AS (SELECT CASE WHEN N1 <= N0 THEN 1 ELSE 0 END AS minority, least(N0, N1) AS n_min, "
        "abs(N0 - N1) AS n_new FROM ct), "
        f"cc AS (SELECT {costs} FROM {src}), "
        f"mp AS (SELECT {fcols}, count(*)::DOUBLE AS m FROM {src}, ct2 WHERE label = ct2.minority "
        f"GROUP BY {fcols}), "
        f"pr AS (SELECT {acols}, {bcols}, {code_a} AS a_code, {code_b} AS b_code, {dist} AS dist, "
        f"CASE WHEN {same} THEN b.m - 1 ELSE b.m END AS avail FROM mp a, mp b, cc c), "
        f"pr2 AS (SELECT *, coalesce(sum(avail) OVER (PARTITION BY a_code ORDER BY dist, b_code "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM pr WHERE avail > 0), "
        f"pr3 AS (SELECT *, least(avail, least({k}.0, (SELECT n_min FROM ct2) - 1) - bef) AS take "
        "FROM pr2), "
        f"vt AS (SELECT a_code, {agrp}, sum(take) AS kk, {ones} FROM pr3 WHERE take > 0 "
        f"GROUP BY a_code, {agrp}), "
        f"al AS (SELECT v.a_code, {syn}, (t.n_new * m.m) / t.n_min AS quota, t.n_new, t.minority "
        "FROM vt v JOIN mp m ON " + " AND ".join(f"v.a_{f} = m.{f}" for f in fs) + ", ct2 t), "
        "al2 AS (SELECT *, floor(quota) AS base, quota - floor(quota) AS frac FROM al), "
        "al3 AS (SELECT *, n_new - sum(base) OVER () AS lft, row_number() OVER "
        "(ORDER BY frac DESC, a_code) AS rr FROM al2), "
        "al4 AS (SELECT *, base + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS draws FROM al3), "
        f"syn AS (SELECT {fcols}, sum(draws)::BIGINT AS n, "
        "CASE WHEN min(minority) = 0 THEN sum(draws) ELSE 0 END::DOUBLE AS w0, "
        "CASE WHEN min(minority) = 1 THEN sum(draws) ELSE 0 END::DOUBLE AS w1, "
        f"true AS is_synthetic FROM al4 WHERE draws > 0 GROUP BY {fcols})")


def depth2_tree_sql(src: str = "tt", features=None) -> str:
    """Gini tree of depth 2 (min leaf 1, min split 2) -> node rows."""
    fs = features or FEATURE_ORDER
    fi = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fs)) + " END"
    unp = " UNION ALL ".join(f"SELECT paper_id, label, '{f}' AS feature, {f}::DOUBLE AS value "
                             f"FROM {src}" for f in fs)
    gini = lambda a, b: (f"(CASE WHEN ({a}) + ({b}) = 0 THEN 0.0 ELSE 1.0 - pow(({a}) / (({a}) + ({b})), 2) "  # noqa: E731
                         f"- pow(({b}) / (({a}) + ({b})), 2) END)")
    return (
        f"lng AS ({unp}), "
        # root
        "r0 AS (SELECT sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0, "
        f"sum(label)::DOUBLE AS n1 FROM {src}), "
        "rs AS (SELECT feature, sum(CASE WHEN value = 0 AND label = 0 THEN 1 ELSE 0 END)::DOUBLE AS l0, "
        "sum(CASE WHEN value = 0 AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS l1 FROM lng GROUP BY feature), "
        f"rg AS (SELECT rs.feature, {fi} AS fi, round({gini('r0.n0', 'r0.n1')} - "
        f"(l0 + l1) / (r0.n0 + r0.n1) * {gini('l0', 'l1')} - "
        f"((r0.n0 - l0) + (r0.n1 - l1)) / (r0.n0 + r0.n1) * {gini('r0.n0 - l0', 'r0.n1 - l1')}, 12) AS gain "
        "FROM rs, r0 WHERE l0 + l1 >= 1 AND (r0.n0 - l0) + (r0.n1 - l1) >= 1 "
        f"AND {gini('r0.n0', 'r0.n1')} > 1e-12), "
        "rb AS (SELECT feature FROM rg ORDER BY gain DESC, fi LIMIT 1), "
        # children
        "ch AS (SELECT l.paper_id, l.label, CASE WHEN l.value <= 0.5 THEN 1 ELSE 2 END AS node_id "
        "FROM lng l JOIN rb ON l.feature = rb.feature), "
        "c0 AS (SELECT node_id, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0, "
        "sum(label)::DOUBLE AS n1 FROM ch GROUP BY node_id), "
        "cs AS (SELECT ch.node_id, g.feature, "
        "sum(CASE WHEN g.value = 0 AND g.label = 0 THEN 1 ELSE 0 END)::DOUBLE AS l0, "
        "sum(CASE WHEN g.value = 0 AND g.label = 1 THEN 1 ELSE 0 END)::DOUBLE AS l1, "
        "count(DISTINCT g.value) AS nv FROM ch JOIN lng g USING (paper_id) GROUP BY ch.node_id, g.feature), "
        f"cg AS (SELECT cs.node_id, cs.feature, {fi.replace('feature', 'cs.feature')} AS fi, "
        f"round({gini('c0.n0', 'c0.n1')} - (l0 + l1) / (c0.n0 + c0.n1) * {gini('l0', 'l1')} - "
        f"((c0.n0 - l0) + (c0.n1 - l1)) / (c0.n0 + c0.n1) * {gini('c0.n0 - l0', 'c0.n1 - l1')}, 12) AS gain "
        "FROM cs JOIN c0 USING (node_id) WHERE nv = 2 AND l0 + l1 >= 1 "
        f"AND (c0.n0 - l0) + (c0.n1 - l1) >= 1 AND c0.n0 + c0.n1 >= 2 AND {gini('c0.n0', 'c0.n1')} > 1e-12), "
        "cb AS (SELECT node_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY node_id "
        "ORDER BY gain DESC, fi) AS rn FROM cg) WHERE rn = 1), "
        "gc AS (SELECT ch.node_id * 2 + CASE WHEN g.value <= 0.5 THEN 1 ELSE 2 END AS node_id, ch.label "
        "FROM ch JOIN cb USING (node_id) JOIN lng g ON g.paper_id = ch.paper_id AND g.feature = cb.feature), "
        "g0 AS (SELECT node_id, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS n0, "
        "sum(label)::DOUBLE AS n1 FROM gc GROUP BY node_id), "
        "nodes2 AS (SELECT 0 AS node_id, (SELECT feature FROM rb) AS feature, n0, n1 FROM r0 "
        "UNION ALL SELECT c0.node_id, cb.feature, c0.n0, c0.n1 FROM c0 LEFT JOIN cb USING (node_id) "
        "UNION ALL SELECT node_id, NULL, n0, n1 FROM g0)")
