"""Scalar functions over answers: encoding, ids, keys, payloads, outcomes.

All native Catalyst expressions; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ANSWER_KEY_PREFIX, ANSWERS

ANSWER_STRUCT = T.StructType([
    T.StructField("evidence", T.StringType()),
    T.StructField("answer", T.StringType()),
])
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("answer", ANSWER_STRUCT),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
])

ENCODINGS = ("include_aware", "unsure_one", "unsure_half")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def encode_answer(answer, question_id, policy: str = "include_aware",
                  on_bad: str = "raise") -> Column:
    """YES/NO/UNSURE to a number.

    include_aware: UNSURE is 1 on inclusion (I*) questions, 0 on exclusion;
    unsure_one: UNSURE is 1; unsure_half: UNSURE is 0.5.  Anything else
    (including null) raises, or gives null with ``on_bad="null"``.
    """
    if policy not in ENCODINGS:
        raise ValueError(f"unknown encoding policy {policy!r}")
    a = _c(answer)
    if policy == "include_aware":
        unsure = F.when(F.upper(F.substring(_c(question_id), 1, 1)) == "I",
                        F.lit(1.0)).otherwise(F.lit(0.0))
    elif policy == "unsure_one":
        unsure = F.lit(1.0)
    else:
        unsure = F.lit(0.5)
    bad = (F.raise_error(F.concat(F.lit("Unexpected value: "),
                                  F.coalesce(a, F.lit("null"))))
           if on_bad == "raise" else F.lit(None))
    return (F.when(a == "NO", F.lit(0.0))
            .when(a == "YES", F.lit(1.0))
            .when(a == "UNSURE", unsure)
            .otherwise(bad.cast("double")))


def norm_qid(col) -> Column:
    """I1 / i1 / I01 -> I01 (letter upper-cased, number left-padded)."""
    c = _c(col)
    num = F.substring(c, F.lit(2), F.length(c))
    return F.concat(F.upper(F.substring(c, 1, 1)),
                    F.when(F.length(num) >= 2, num).otherwise(F.lpad(num, 2, "0")))


def reason_list(arr) -> Column:
    """["a","b"] -> "0: a\\n1: b"."""
    return F.array_join(
        F.transform(_c(arr), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)),
        "\n")


def answer_key(title, abstract, question, model, mode=None,
               prefix: str = ANSWER_KEY_PREFIX) -> Column:
    """prefix:sha256(compact JSON {title, abstract, question, model[, mode]}).

    ``mode=None`` gives the legacy key that ignores the asking mode."""
    fields = [F.coalesce(_c(title), F.lit("")).alias("title"),
              F.coalesce(_c(abstract), F.lit("")).alias("abstract"),
              F.coalesce(_c(question), F.lit("")).alias("question"),
              _c(model).alias("model")]
    if mode is not None:
        fields.append(_c(mode).alias("mode"))
    js = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + ":"), F.sha2(js, 256))


def parse_payload(col) -> Column:
    """F8: JSON payload -> struct; malformed text gives a struct of nulls."""
    return F.from_json(_c(col), PAYLOAD_SCHEMA)


def valid_answer(parsed) -> Column:
    """True when the parsed payload carries an answer from the vocabulary."""
    return F.coalesce(_c(parsed).getField("answer").getField("answer").isin(*ANSWERS),
                      F.lit(False))


def cache_payload(answer, evidence, prompt_tokens, completion_tokens) -> Column:
    """the stored JSON for one answer."""
    return F.to_json(F.struct(
        F.struct(_c(evidence).alias("evidence"), _c(answer).alias("answer")).alias("answer"),
        _c(prompt_tokens).cast("long").alias("prompt_tokens"),
        _c(completion_tokens).cast("long").alias("completion_tokens")))


def outcome_class(label, prediction) -> Column:
    """TP / FN / FP / TN."""
    y, p = _c(label), _c(prediction)
    return (F.when((y == 1) & (p == 1), "TP").when((y == 1) & (p == 0), "FN")
            .when((y == 0) & (p == 1), "FP").when((y == 0) & (p == 0), "TN"))


def decide(probability, threshold: float = 0.5) -> Column:
    """Inclusive threshold decision."""
    return (_c(probability) >= F.lit(float(threshold))).cast("int")


def positive_share(n0, n1) -> Column:
    """share of class 1 at a node."""
    return F.try_divide(_c(n1).cast("double"), (_c(n0) + _c(n1)).cast("double"))
