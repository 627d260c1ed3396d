"""Answer providers.

A provider turns (paper text, question) into (answer, evidence, tokens).
Shipped providers:

* ``RuleProvider``: three-valued regex rules as native ``rlike`` /
  ``regexp_extract`` (literal patterns, compiled once per task, codegen'd).
* ``ReplayProvider``: answers read back from a stored answer table (join).
* ``PandasProvider``: a caller's own model as an Arrow-batched
  ``mapInPandas`` over request rows, with bounded parallelism (T3).

``answer_requests`` answers one question a row; ``select_requests`` gives the
reply to a multi-select, the ids of all exclusion reasons that hold.

Rules always run on ASCII-folded text: ``\\b`` differs between Java and RE2 on
non-ASCII input.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from ..constants import DEFAULT_MODEL_NAME, RULE_STEMS, RULES


def paper_text(title="title_clean", abstract="abstract_clean") -> Column:
    """The text a provider reads: title and abstract, joined by a newline
    when both are present."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(abstract) if isinstance(abstract, str) else abstract
    return (F.when(t == "", a).when(a == "", t)
            .otherwise(F.concat(t, F.lit("\n"), a)))


def rule_matches(text: Column, qid: str, rules=RULES) -> list[Column]:
    """Whether the YES and the UNSURE pattern match; texts without any string
    that the pattern needs are told apart without the pattern."""
    stems = RULE_STEMS.get(qid) if rules.get(qid) == RULES.get(qid) else None
    out = []
    for i, pattern in enumerate(rules[qid]):
        hit = text.rlike(pattern)
        if stems:
            some = text.contains(stems[i][0])
            for s in stems[i][1:]:
                some = some | text.contains(s)
            hit = some & hit
        out.append(hit)
    return out


def rule_answer(text: Column, qid: str, rules=RULES) -> Column:
    yes, unsure = rule_matches(text, qid, rules)
    return F.when(yes, F.lit("YES")).when(unsure, F.lit("UNSURE")).otherwise(F.lit("NO"))


def rule_evidence(text: Column, qid: str, rules=RULES) -> Column:
    yes, unsure = rule_matches(text, qid, rules)
    return (F.when(yes, F.regexp_extract(text, rules[qid][0], 0))
            .when(unsure, F.regexp_extract(text, rules[qid][1], 0))
            .otherwise(F.lit("")))


class RuleProvider:
    """Regex rules; every answer is a native expression."""

    def __init__(self, rules: dict | None = None, model: str = DEFAULT_MODEL_NAME):
        self.rules = dict(rules or RULES)
        self.model = model

    @property
    def question_ids(self) -> list[str]:
        return list(self.rules)

    def answer_struct(self, text: Column, qid: str) -> Column:
        return F.struct(rule_answer(text, qid, self.rules).alias("answer"),
                        rule_evidence(text, qid, self.rules).alias("evidence"))

    def answers_map(self, text: Column, qids: Iterable[str] | None = None) -> Column:
        """map<question_id, answer> for one paper, no shuffle.  Evidence is
        not materialised here; ``evidence_of`` extracts it only for the
        questions a walk actually asks."""
        qids = list(qids or self.question_ids)
        kv = []
        for q in qids:
            kv += [F.lit(q), rule_answer(text, q, self.rules)]
        return F.create_map(*kv)

    def answer_for(self, text: Column, qid: Column,
                   qids: Iterable[str] | None = None) -> Column:
        """Answer to the question named by column ``qid`` (one branch runs);
        null for a question without a rule, or not among ``qids``."""
        out = F.lit(None).cast("string")
        for q in self.question_ids if qids is None else qids:
            out = F.when(qid == q, rule_answer(text, q, self.rules)).otherwise(out)
        return out

    def evidence_of(self, text: Column, qid: Column, answer: Column,
                    qids: Iterable[str] | None = None) -> Column:
        """Evidence of an answer already given to the question named by column
        ``qid``: one match of the one pattern that gave it."""
        out = F.lit(None).cast("string")
        for q in self.question_ids if qids is None else qids:
            yes, unsure = self.rules[q]
            own = (F.when(answer == "YES", F.regexp_extract(text, yes, 0))
                   .when(answer == "UNSURE", F.regexp_extract(text, unsure, 0)).otherwise(F.lit("")))
            out = F.when(qid == q, own).otherwise(out)
        return out

    def answer_wide(self, df: DataFrame, text: Column,
                    qids: Iterable[str] | None = None) -> DataFrame:
        """One answer column per question."""
        qids = list(qids or self.question_ids)
        return df.select("*", *[rule_answer(text, q, self.rules).alias(q) for q in qids])

    def answer_long(self, df: DataFrame, text: Column, key_cols=("paper_id",),
                    qids: Iterable[str] | None = None) -> DataFrame:
        """(key, question_id, answer, evidence, tokens, model): one row per
        paper and question, produced by a generator, not a join."""
        qids = list(qids or self.question_ids)
        # answers in one projection first, so a rule's match is extracted as
        # evidence only when the rule matched (a NO costs two scans, not four)
        a = df.select(*key_cols, text.alias("_t"),
                      *[rule_answer(text, q, self.rules).alias("_a_" + q) for q in qids])

        def evidence(q):
            yes, unsure = self.rules[q]
            ans = F.col("_a_" + q)
            return (F.when(ans == "YES", F.regexp_extract(F.col("_t"), yes, 0))
                    .when(ans == "UNSURE", F.regexp_extract(F.col("_t"), unsure, 0))
                    .otherwise(F.lit("")))
        rows = F.array(*[F.struct(F.lit(q).alias("question_id"), F.col("_a_" + q).alias("answer"),
                                  evidence(q).alias("evidence")) for q in qids])
        return (a.select(*key_cols, F.inline(rows))
                .withColumn("prompt_tokens", F.lit(0).cast("long"))
                .withColumn("completion_tokens", F.lit(0).cast("long"))
                .withColumn("model", F.lit(self.model)))

    def answer_requests(self, req: DataFrame, text: Column,
                        qid_col: str = "question_id") -> DataFrame:
        """Answer a request table (any rows with a question id column).
        Questions without a rule get no answer (null), i.e. a miss."""
        ans = F.lit(None).cast("string")
        ev = F.lit(None).cast("string")
        for q in self.question_ids:
            ans = F.when(F.col(qid_col) == q, rule_answer(text, q, self.rules)).otherwise(ans)
            ev = F.when(F.col(qid_col) == q, rule_evidence(text, q, self.rules)).otherwise(ev)
        return (req.withColumn("answer", ans).withColumn("evidence", ev)
                .withColumn("prompt_tokens", F.lit(0).cast("long"))
                .withColumn("completion_tokens", F.lit(0).cast("long"))
                .withColumn("model", F.lit(self.model)))


class ReplayProvider:
    """Answers replayed from a stored answer table keyed by
    (paper_id, question_id), and mode where the table has one; unknown pairs
    are misses.  ``selections``: replayed multi-select replies (paper_id, ids,
    evidence); ``replies``: replayed all-at-once replies (paper_id, payload)."""

    def __init__(self, answers: DataFrame | None, model: str = DEFAULT_MODEL_NAME,
                 selections: DataFrame | None = None, replies: DataFrame | None = None):
        self.model, self.selections, self.replies = model, selections, replies
        if answers is None:
            return
        self.by_mode = "mode" in answers.columns
        self.answers = answers.select(
            "paper_id", "question_id", *(["mode"] if self.by_mode else []), "answer", "evidence",
            "prompt_tokens", "completion_tokens")

    def answer_requests(self, req: DataFrame, text: Column | None = None,
                        qid_col: str = "question_id") -> DataFrame:
        a = self.answers.withColumnRenamed("question_id", qid_col)
        on = ["paper_id", qid_col]
        if self.by_mode:
            if "mode" in req.columns:
                on.append("mode")
            else:
                a = a.where("mode = 'single'").drop("mode")
        return req.join(a, on, "left").withColumn("model", F.lit(self.model))

    def select_requests(self, req: DataFrame) -> DataFrame:
        if self.selections is None:
            raise ValueError("this provider has no multi-select replies")
        return req.join(self.selections.select("paper_id", "ids", "evidence"), "paper_id", "left")

    def reply_requests(self, req: DataFrame) -> DataFrame:
        if self.replies is None:
            raise ValueError("this provider has no all-at-once replies")
        return req.join(self.replies.select("paper_id", "payload"), "paper_id", "left")


class PandasProvider:
    """A caller's model over Arrow batches.

    ``fn(pdf) -> pdf`` receives columns paper_id, question_id, question,
    title, abstract (and mode, where the requests have it) and returns
    paper_id, question_id, answer, evidence, prompt_tokens, completion_tokens.
    For a multi-select (mode ``exclusion``, question_id null, question = the
    numbered reasons) it returns paper_id, ids (a list of numbers) and evidence;
    for an all-at-once request (mode ``all``) paper_id and payload (JSON text).

    At most ``parallelism`` tasks call at once (T3), each with ``in_flight``
    calls of ``rows_per_call`` rows under way; requests for one paper stay
    together, sorted by question, for prompt-prefix reuse.  A call that raises
    is tried ``retries`` more times, waiting ``backoff`` seconds and twice as
    long each time; then its rows are asked in halves, so only the rows that
    fail alone have no answer and an ``error``.  Nothing raised ends the job.
    """

    OUT = T.StructType([
        T.StructField("paper_id", T.LongType()), T.StructField("question_id", T.StringType()),
        T.StructField("answer", T.StringType()), T.StructField("evidence", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()), T.StructField("error", T.StringType())])
    SELECTED = T.StructType([
        T.StructField("paper_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("evidence", T.StringType()), T.StructField("error", T.StringType())])

    def __init__(self, fn: Callable, model: str, parallelism: int = 8, in_flight: int = 1,
                 rows_per_call: int | None = None, retries: int = 0, backoff: float = 0.5):
        self.fn, self.model, self.parallelism = fn, model, parallelism
        self.in_flight, self.rows_per_call = in_flight, rows_per_call
        self.retries, self.backoff = retries, backoff

    def _calls(self, names: list[str]):
        """The function for mapInPandas: answers with columns ``names``."""
        fn, size, flight = self.fn, self.rows_per_call, self.in_flight
        retries, backoff = self.retries, self.backoff

        def once(pdf):
            for left in range(retries, -1, -1):
                try:
                    out = fn(pdf.reset_index(drop=True)).copy()
                    out["error"] = None
                    return out[names]
                except Exception as exc:  # noqa: BLE001 (a caller's model may raise anything)
                    said = f"{type(exc).__name__}: {exc}"
                    if left:
                        time.sleep(backoff * 2 ** (retries - left))
            if len(pdf) > 1:
                half = len(pdf) // 2
                return pd.concat([once(pdf.iloc[:half]), once(pdf.iloc[half:])])
            out = pdf.reindex(columns=names)
            out["error"] = said
            out[[n for n in names if n not in ("paper_id", "question_id", "error")]] = None
            return out

        def run(batches):
            with ThreadPoolExecutor(flight) as pool:
                window = deque()
                for pdf in batches:
                    step = size or max(1, len(pdf))
                    for at in range(0, len(pdf), step):
                        window.append(pool.submit(once, pdf.iloc[at:at + step]))
                        if len(window) >= flight:
                            yield window.popleft().result()
                while window:
                    yield window.popleft().result()
        return run

    def _dealt(self, req: DataFrame) -> DataFrame:
        return (req.repartition(self.parallelism, "paper_id")
                .sortWithinPartitions("paper_id", "question_id"))

    def answer_requests(self, req: DataFrame, text: Column | None = None,
                        qid_col: str = "question_id") -> DataFrame:
        cols = ["paper_id", qid_col, "question", "title", "abstract",
                *[c for c in ("mode",) if c in req.columns]]
        out = (self._dealt(req.select(*cols).withColumnRenamed(qid_col, "question_id"))
               .mapInPandas(self._calls(self.OUT.fieldNames()), self.OUT)
               .withColumnRenamed("question_id", qid_col))
        return (req.join(out, ["paper_id", qid_col], "left")
                .withColumn("model", F.lit(self.model)))

    def select_requests(self, req: DataFrame) -> DataFrame:
        cols = ["paper_id", "question_id", "question", "title", "abstract", "mode"]
        out = self._dealt(req.select(*cols)).mapInPandas(
            self._calls(self.SELECTED.fieldNames()), self.SELECTED)
        return req.join(out, "paper_id", "left")

    def reply_requests(self, req: DataFrame) -> DataFrame:
        out = self._dealt(req).mapInPandas(self._calls(["paper_id", "payload", "error"]),
                                           "paper_id long, payload string, error string")
        return req.join(out, "paper_id", "left")


LOGGED = T.StructType([*PandasProvider.OUT.fields[:6], T.StructField("mode", T.StringType())])


def ask_logged(provider, requests: DataFrame, path: str, per_wave: int = 1_000_000) -> DataFrame:
    """``requests`` (paper_id, question_id, mode, question, title, abstract)
    with their answers, through a log in the shared folder ``path``.

    What the log answers is not asked again; the rest is asked in waves of
    about ``per_wave`` requests, and each wave's answers are appended to the log
    in one job, so a run that ends early costs at most one wave and a rerun
    asks only what has no answer yet."""
    spark, key = requests.sparkSession, ["paper_id", "question_id", "mode"]
    spark.createDataFrame([], LOGGED).write.mode("ignore").parquet(path)
    requests = cut_lineage(requests.distinct())
    missing = cut_lineage(requests.join(spark.read.schema(LOGGED).parquet(path).select(*key),
                                        key, "left_anti"))
    waves = -(-missing.count() // per_wave)
    for wave in range(waves):
        part = missing.where(F.pmod(F.xxhash64("paper_id"), F.lit(waves)) == wave)
        (provider.answer_requests(part).where("answer IS NOT NULL").select(*LOGGED.fieldNames())
         .write.mode("append").parquet(path))
    return requests.join(spark.read.schema(LOGGED).parquet(path), key, "left")
