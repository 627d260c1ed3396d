"""Extraction flows: work list (J2), prompts (F6), per-question extraction
(C5) and all-at-once extraction (C6), and the training feature table.

The work list never replicates paper text: it carries (paper_id,
question_id, answer_key).  A native provider answers a paper's questions
with a generator over one row (text read once); the question bank is a
broadcast side of fixed, checked size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import cut_lineage
from ..constants import ANSWERS, DEFAULT_MODEL_NAME, FEATURE_ORDER
from ..functions.answers import answer_key, encode_answer, norm_qid, reason_list
from ..operators.features import encode_features
from ..operators.rules import RuleProvider, rule_answer
from ..sources.questions import question_rows
from .precheck import of_mode

# Prompt templates of this library (not a fixed value of the method: any
# wording works, only the structure matters: system, user, question).
SYSTEM_SINGLE = ("You screen scientific papers by title and abstract for a systematic "
                 "review. Answer the screening question with YES, NO or UNSURE and quote "
                 "the evidence. Prefer UNSURE over NO when the abstract does not say.")
SYSTEM_DANGER = (SYSTEM_SINGLE + " A YES here removes the paper from the review, so answer YES only "
                 "when the abstract states it plainly.")
SYSTEM_EXCLUSION = ("You screen scientific papers by title and abstract. From the numbered "
                    "exclusion reasons, return the ids of every reason that is true for the "
                    "paper, with evidence.")
SYSTEM_ALL = ("You screen scientific papers by title and abstract. Answer each numbered "
              "question with YES, NO or UNSURE, with evidence, as one list in their order.")


def bank_questions(qids: list[str] | None = None) -> list[tuple[str, str]]:
    """(question_id, question) of the bank, optionally a subset."""
    return [(q, text) for q, text, _cat, _ie in question_rows() if qids is None or q in qids]


def question_array(questions: list[tuple[str, str]]):
    """The (fixed, small) question list as a literal array for a generator."""
    return F.array(*[F.struct(F.lit(q).alias("question_id"), F.lit(t).alias("question"))
                     for q, t in questions])


def work_list(prepared: DataFrame, questions: list[tuple[str, str]],
              model: str = DEFAULT_MODEL_NAME, mode: str = "single") -> DataFrame:
    """Papers x questions with the memo key of each pair (a generator
    over the fixed question list: no join, text read once per paper)."""
    return prepared.select("paper_id", "title_clean", "abstract_clean",
                           F.inline(question_array(questions))).select(
        "paper_id", "question_id",
        answer_key("title_clean", "abstract_clean", "question", F.lit(model),
                   F.lit(mode)).alias("answer_key"))


def prompts(prepared: DataFrame, questions: list[tuple[str, str]],
            reasons_text: list[str]) -> DataFrame:
    """rendered messages, ready for a batch provider:
    paper_id, question_id, mode, system, user.  Modes: ``single`` (a question),
    ``exclusion`` (all reasons, several may hold), ``confirm`` (one reason) and
    ``all`` (every question at once).  One generator, so the text is cleaned
    once."""
    paper = F.concat(F.lit("Title: "), F.col("title_clean"), F.lit("\n\nAbstract: "),
                     F.col("abstract_clean"))

    def message(qid, mode, system, tail):
        return F.struct(F.lit(qid).cast("string").alias("question_id"), F.lit(mode).alias("mode"),
                        F.lit(system).alias("system"), tail.alias("tail"))

    def listed(texts):
        return reason_list(F.array(*[F.lit(t) for t in texts]))

    messages = [message(q, "single", SYSTEM_SINGLE, F.lit(f"Question: {t}")) for q, t in questions]
    messages += [message(None, "exclusion", SYSTEM_EXCLUSION,
                         F.concat(F.lit("Exclusion reasons:\n"), listed(reasons_text)))]
    messages += [message(str(i), "confirm", SYSTEM_DANGER, F.lit(f"Question: {t}"))
                 for i, t in enumerate(reasons_text)]
    messages += [message(None, "all", SYSTEM_ALL,
                         F.concat(F.lit("Questions:\n"), listed([t for _q, t in questions])))]
    return prepared.select("paper_id", paper.alias("_paper"), F.inline(F.array(*messages))).select(
        "paper_id", "question_id", "mode", "system",
        F.concat("_paper", F.lit("\n\n"), F.col("tail")).alias("user"))


def asked_answers(prepared: DataFrame, provider, qids: list[str],
                  store: DataFrame | None = None) -> DataFrame:
    """Every question of every paper, from the store or else asked of an
    external provider (mode ``single``), once: the answers are checkpointed.
    paper_id, question_id, answer (null: none), prompt_tokens, completion_tokens."""
    requests = prepared.select("paper_id", F.col("title_clean").alias("title"),
                               F.col("abstract_clean").alias("abstract"),
                               F.inline(question_array(bank_questions(qids)))).withColumn(
        "mode", F.lit("single"))
    side = of_mode(store, "single")
    cols = ["paper_id", "question_id", "answer", "prompt_tokens", "completion_tokens"]
    if side is None:
        return cut_lineage(provider.answer_requests(requests).select(*cols))
    side = side.select(*cols)
    missing = requests.join(side.select("paper_id", "question_id"), ["paper_id", "question_id"],
                            "left_anti")
    got = cut_lineage(provider.answer_requests(missing).select(*cols))
    known = side.where(F.col("question_id").isin(*qids)).join(
        prepared.select("paper_id"), "paper_id", "left_semi")
    return got.unionByName(known)


def extract_long(prepared: DataFrame, provider=None, qids: list[str] | None = None,
                 store: DataFrame | None = None, policy: str = "include_aware") -> DataFrame:
    """Every question per paper; a paper with any unanswered question is
    'incomplete' (its features stay null); tokens are summed; the complete
    ones are pivoted and encoded.

    A native provider answers in-row: without a store nothing is shuffled."""
    provider = provider or RuleProvider()
    qids = list(qids or getattr(provider, "question_ids", None) or [q for q, _t in bank_questions()])
    native = hasattr(provider, "answer_long")
    if native and store is None:
        wide = (provider.answer_wide(prepared.select("paper_id", "text"), F.col("text"), qids)
                .drop("text"))
        none = F.lit(0).cast("long")
        wide = wide.select("*", F.size(F.array_compact(F.array(*qids))).alias("_answered"),
                           none.alias("input_tokens"), none.alias("output_tokens"))
    else:
        long = (_with_store(provider.answer_long(prepared, F.col("text"), qids=qids), store) if native
                else asked_answers(prepared, provider, qids, store))
        wide = _pivoted(long.where(F.col("answer").isNotNull()), qids)
        if not native:  # papers without any answer
            wide = prepared.select("paper_id").join(wide, "paper_id", "left").na.fill(
                0, ["_answered", "input_tokens", "output_tokens"])
    status = F.when(F.col("_answered") == len(qids), F.lit("complete")).otherwise(F.lit("incomplete"))
    complete = F.col("status") == "complete"
    enc = [F.when(complete, encode_answer(F.col(q), F.lit(q), policy)).alias(q) for q in qids]
    return (wide.withColumn("status", status)
            .select("paper_id", "status", "input_tokens", "output_tokens", *enc))


def _with_store(long: DataFrame, store: DataFrame) -> DataFrame:
    """Answers of a native provider, the store's where it has one."""
    s = store.select("paper_id", "question_id", F.col("answer").alias("_s_a"),
                     F.col("prompt_tokens").alias("_s_pt"),
                     F.col("completion_tokens").alias("_s_ct"))
    return (long.join(s, ["paper_id", "question_id"], "left")
            .withColumn("answer", F.coalesce("_s_a", "answer"))
            .withColumn("prompt_tokens", F.coalesce("_s_pt", "prompt_tokens"))
            .withColumn("completion_tokens", F.coalesce("_s_ct", "completion_tokens"))
            .drop("_s_a", "_s_pt", "_s_ct"))


def _pivoted(long: DataFrame, qids: list[str]) -> DataFrame:
    """A1 + A9 + A10 in two aggregates and no join: per (paper, question) the
    answer, its multiplicity (a duplicate raises, as in pivot_answers) and the
    tokens; per paper the pivot, the answered count and token sums."""
    per = (long.groupBy("paper_id", "question_id").agg(
        F.first("answer", ignorenulls=True).alias("_v"), F.count(F.lit(1)).alias("_n"),
        F.sum("prompt_tokens").alias("_pt"), F.sum("completion_tokens").alias("_ct"))
        .withColumn("_v", F.when(F.col("_n") > 1, F.raise_error(F.concat(
            F.lit("duplicate answer for paper "), F.col("paper_id").cast("string"),
            F.lit(" question "), F.col("question_id")))).otherwise(F.col("_v"))))
    return per.groupBy("paper_id").agg(
        F.count(F.when(F.col("question_id").isin(*qids), F.lit(1))).alias("_answered"),
        F.sum("_pt").cast("long").alias("input_tokens"),
        F.sum("_ct").cast("long").alias("output_tokens"),
        *[F.max(F.when(F.col("question_id") == q, F.col("_v"))).alias(q) for q in qids])


def parse_replies(replies: DataFrame, qids: list[str], payload: str = "payload") -> DataFrame:
    """F8 of all-at-once replies: (paper_id, JSON text) to paper_id, question_id,
    answer, evidence, one row a valid answer.

    A reply's shape varies: an object of questions, or a list of objects with an
    ``id``; an answer is a word or an object with ``answer`` and ``evidence``;
    ids are spelled i1, I1, i01 or I01.  Malformed text, unknown ids and words
    outside the vocabulary are misses, as is a question answered in two ways."""
    spark = replies.sparkSession
    parsed = replies.select("paper_id", F.try_parse_json(payload).alias("_v")).where("_v IS NOT NULL")
    parts = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))

    def get(path):
        return F.try_variant_get("value", path, "string")
    said = parts.select(
        "paper_id", F.coalesce("key", get("$.id"), get("$.question_id")).alias("_id"),
        F.coalesce(get("$.answer"), get("$")).alias("answer"), get("$.evidence").alias("evidence"))
    known = said.where(F.col("_id").rlike("^[IEie][0-9]{1,2}$") & F.col("answer").isin(*ANSWERS)) \
        .withColumn("question_id", norm_qid("_id")).where(F.col("question_id").isin(*qids))
    return (known.groupBy("paper_id", "question_id")
            .agg(F.min("answer").alias("answer"), F.max("answer").alias("_other"),
                 F.min_by("evidence", "answer").alias("evidence"))
            .where("answer = _other").drop("_other"))


def all_at_once_requests(prepared: DataFrame, qids: list[str]) -> DataFrame:
    """One request a paper (mode ``all``): every question, numbered by its id."""
    listed = "\n".join(f"{q[0].lower()}{q[1:]}: {t}" for q, t in bank_questions(qids))
    return prepared.select("paper_id", F.lit(None).cast("string").alias("question_id"),
                           F.col("title_clean").alias("title"),
                           F.col("abstract_clean").alias("abstract"),
                           F.lit(listed).alias("question"), F.lit("all").alias("mode"))


def extract_unpivot(prepared: DataFrame, provider=None, qids: list[str] | None = None) -> DataFrame:
    """One all-at-once reply per paper, as rows with canonical ids (F4):
    paper_id, question_id, answer (null: the reply has no valid answer).

    A native provider's reply is a struct (fields i01, e02, ...) unpivoted
    in-row; an external one is asked once a paper and its JSON replies parsed."""
    provider = provider or RuleProvider()
    qids = list(qids or getattr(provider, "question_ids", None) or [q for q, _t in bank_questions()])
    if not hasattr(provider, "answer_long"):
        replies = cut_lineage(provider.reply_requests(all_at_once_requests(prepared, qids))
                              .select("paper_id", "payload"))
        answers = parse_replies(replies, qids).select("paper_id", "question_id", "answer")
        every = prepared.select("paper_id", F.explode(F.array(*map(F.lit, qids))).alias("question_id"))
        return every.join(answers, ["paper_id", "question_id"], "left")
    fields = [q[0].lower() + q[1:] for q in qids]
    struct = F.struct(*[rule_answer(F.col("text"), q, provider.rules).alias(f)
                        for q, f in zip(qids, fields)])
    d = prepared.select("paper_id", struct.alias("multi")).select("paper_id", "multi.*")
    long = d.unpivot("paper_id", fields, "field", "answer")
    return long.select("paper_id", norm_qid("field").alias("question_id"), "answer")


def training_table(prepared: DataFrame, labels: DataFrame, features=FEATURE_ORDER,
                   provider: RuleProvider | None = None, policy: str = "include_aware") -> DataFrame:
    """Encoded features of the labelled papers: paper_id, label, features.

    Answers come in-row from the provider (no pivot shuffle); the label join
    is the one shuffle, on paper_id."""
    provider = provider or RuleProvider()
    if "label" in prepared.columns:
        # labels were joined before cleaning, so only labelled papers are
        # cleaned and asked; the label rides along and no join follows
        wide = provider.answer_wide(prepared.select("paper_id", "label", "text"),
                                    F.col("text"), features)
        enc = encode_features(wide.drop("text"), list(features), policy)
        return enc.select("paper_id", "label", *features)
    wide = provider.answer_wide(prepared.select("paper_id", "text"), F.col("text"), features)
    enc = encode_features(wide.drop("text"), list(features), policy)
    return enc.join(labels, "paper_id").select("paper_id", "label", *features)
