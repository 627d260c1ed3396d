import hashlib
import json

import pytest
from pyspark.sql import functions as F

from papersieve.functions import answers as A
from papersieve.functions.text import ascii_fold, html_to_text


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_ascii_fold_edges(spark):
    assert one(spark, ascii_fold("v"), "Screen‐based") == "Screenbased"
    assert one(spark, ascii_fold("v"), "ﬁ ½ é ß Ⅳ") == "fi 12 e  IV"


def test_html_to_text_edges(spark):
    assert one(spark, html_to_text("v"), "p < 0.05") == "p < 0.05"
    assert one(spark, html_to_text("v"), "AT&amp;lt;") == "AT&lt;"
    assert one(spark, html_to_text("v"), '<script>var t="</p>"</script>x') == "x"
    assert one(spark, html_to_text("v"), "<p>a<!-- c --><b>b</b></p>") == "ab"


def test_encode_policies(spark):
    df = spark.createDataFrame([("I01", "UNSURE"), ("E01", "UNSURE"), ("I01", "YES"),
                                ("E02", "NO")], "q string, a string")
    got = [r[0] for r in df.select(A.encode_answer("a", "q")).collect()]
    assert got == [1.0, 0.0, 1.0, 0.0]
    got = [r[0] for r in df.select(A.encode_answer("a", "q", "unsure_half")).collect()]
    assert got == [0.5, 0.5, 1.0, 0.0]
    bad = spark.createDataFrame([("I01", "maybe"), ("I01", None)], "q string, a string")
    with pytest.raises(Exception):
        bad.select(A.encode_answer("a", "q")).collect()
    got = [r[0] for r in bad.select(A.encode_answer("a", "q", on_bad="null")).collect()]
    assert got == [None, None]


def test_norm_qid_reason_list(spark):
    df = spark.createDataFrame([("I1",), ("e12",), ("I01",)], "v string")
    assert [r[0] for r in df.select(A.norm_qid("v")).collect()] == ["I01", "E12", "I01"]
    arr = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    assert arr.select(A.reason_list("v")).first()[0] == "0: a\n1: b"


def test_answer_key_matches_json_sha256(spark):
    title, abstract, question, model = 'A "t"\\x', "line1\nline2\ttab", "Q?", "m"
    df = spark.createDataFrame([(title, abstract, question, model)], "t string, a string, q string, m string")
    got = df.select(A.answer_key("t", "a", "q", "m")).first()[0]
    payload = json.dumps({"title": title, "abstract": abstract, "question": question,
                          "model": model}, ensure_ascii=True, separators=(",", ":"))
    assert got == "llm-single-question:" + hashlib.sha256(payload.encode()).hexdigest()
    # null title is the empty string; a different mode gives a different key
    df2 = spark.createDataFrame([(None, abstract, question, model)], "t string, a string, q string, m string")
    k_null = df2.select(A.answer_key("t", "a", "q", "m")).first()[0]
    payload = json.dumps({"title": "", "abstract": abstract, "question": question,
                          "model": model}, ensure_ascii=True, separators=(",", ":"))
    assert k_null.endswith(hashlib.sha256(payload.encode()).hexdigest())
    k1 = df.select(A.answer_key("t", "a", "q", "m", F.lit("single"))).first()[0]
    k2 = df.select(A.answer_key("t", "a", "q", "m", F.lit("danger"))).first()[0]
    assert k1 != k2


def test_payload_roundtrip_and_malformed(spark):
    df = spark.createDataFrame([('YES', 'ev', 3, 4)], "a string, e string, p long, c long")
    js = df.select(A.cache_payload("a", "e", "p", "c").alias("j")).first()["j"]
    assert json.loads(js) == {"answer": {"evidence": "ev", "answer": "YES"},
                              "prompt_tokens": 3, "completion_tokens": 4}
    bad = spark.createDataFrame([('{"answer": ',), ('{"answer":{"answer":"MAYBE"}}',), (js,)], "j string")
    got = [r[0] for r in bad.select(A.valid_answer(A.parse_payload("j"))).collect()]
    assert [bool(g) for g in got] == [False, False, True]


def test_outcome_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    assert [r[0] for r in df.select(A.outcome_class("y", "p")).collect()] == ["TP", "FN", "FP", "TN"]


def test_character_references(spark):
    from html import unescape

    from papersieve.functions.text import decode_references
    cases = ["a &#8217; b", "&#x2013;&eacute;&ndash;&lt;p&gt;", "&amp;lt; &amp;amp;", "&unknown; & x",
             "&#0;&#x110000;&#55296;", "&#128512; &quot;&apos;&#39;", "no reference", "&;&#;&#x;", "a&nbsp;b", ""]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string")
           .select(decode_references("t")).collect()]
    assert got == [unescape(c) for c in cases]
    assert spark.createDataFrame([(None,)], "t string").select(decode_references("t")).collect()[0][0] is None


def test_html_as_a_parser_reads_it(spark):
    """Quoted attribute values, what is never closed, references without
    semicolons, and long tags."""
    cases = {'<a title="x > y">t</a>': "t", "<a title='x > y' b=\"</a>\">t</a>": "t",
             "<p>a<!-- open": "a", "a<script>var x = 1;": "a", "a<style media='>'>p {}</style>b": "ab",
             "<a title=it's>t</a>": "t", '<a href=x"y>t': "t", "A &amp B &lt c": "A & B < c",
             "&ampx &notit; &notanamexx;": "&x ¬it; ¬anamexx;", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
             "<!doctype html><title>T</title>x": "Tx", "&#128512;&#x41;": "\U0001f600A",
             "a<br/>b<hr >c": "abc", "<p data-x = \"1>2\">q": "q",
             "<a " + "x='>' " * 20_000 + ">t": "t", "<!--" + "- " * 100_000 + "-->u": "u"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, v string")
    got = {r.i: r.t for r in df.select("i", html_to_text("v").alias("t")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_each_pattern_is_tried_once_a_paper(spark):
    """The flat screen's plan tests no pattern twice and extracts no evidence."""
    import re

    from papersieve.plans.catalog import screened

    from .conftest import SF001
    plan = screened(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan
    for pattern in (r"[#*$&%]{3}", r"[A-Za-z0-9._]+@", r"!!"):
        assert len(re.findall(rf"RLIKE\(text#\d+, {re.escape(pattern)}\)", plan)) == 1, pattern
