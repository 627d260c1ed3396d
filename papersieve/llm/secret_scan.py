"""Operator 1, secret scans with a random forest against false positives.

Candidates are long runs of key characters that hold a digit, known key formats,
values assigned to a name with a word for a secret (a quoted one to its closing
quote), and private key blocks.  A forest over each candidate's length,
character transitions, dictionary coverage, path and neighbouring words decides
which are secrets.  It is trained from labelled findings: given ones, or those
of :func:`confirmed`, which labels the clear cases of the corpus by known key
formats, assignments and known harmless formats.  Known key formats and quoted
pass phrases are secrets whatever the forest says of them.  All of it is
DataFrame operations and MLlib.

Patterns take time in proportion to the text: every look-ahead is bounded or
possessive, no group is repeated by recursion, and a run once begun is taken
whole.
"""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import cut_lineage
from .frames import read_table, take_columns, with_plain_names

PRIVATE_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+"
               r"-----END [A-Z ]*PRIVATE KEY-----")
#: Known key formats (fixed values).
ISSUED = (r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30}"
          r"|sk_(?:live|test)_[A-Za-z0-9]{16}|xox[abprs]-[A-Za-z0-9-]{10}"
          r"|eyJ[A-Za-z0-9_-]{1,512}+\.eyJ[A-Za-z0-9_-]|AIza[0-9A-Za-z_-]{35}"
          r"|-----BEGIN)")
SECRET_WORDS = r"token|secret|passw|passphrase|pwd|key|auth|bearer|credential|signature"
#: What ends left of a quoted value that is a pass phrase whatever its words,
#: and values that stand for none.
PHRASE = (r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret)[a-z0-9_.-]{0,24}[\"'`]?\]?"
          r"\s{0,4}(?:=>|:=|={1,3}|:)\s{0,4}[\"'`]$")
NO_PHRASE = r"(?i)^(?:[$<{%*.]|your|my[ _-]|enter|change|example|placeholder|dummy|none$|null$|true$|false$)"
OTHER_WORDS = r"sha|md5|commit|checksum|digest|uuid|version|example|placeholder|dummy|revision"
#: '=' belongs to a candidate as trailing padding only: at an inner one, name
#: and '=' are the left context of the value.
PADDING = r"={1,2}(?![\"'`]?[A-Za-z0-9+/_.@=-])"
#: After a name with a word for a secret and '=' or ':' (the first look is a
#: cheap one that most places fail).
ASSIGNED = (r"(?<=[=:>]\s{0,4}[\"'`]?)(?:(?!=)|(?<=[\"'`]))(?<=(?i:" + SECRET_WORDS.replace("auth", "auth(?!or(?!i))")
            + r")[A-Za-z0-9_.-]{0,24}[\"'`]?\]?\s{0,4}(?:=>|:=|={1,3}|:)\s{0,4}[\"'`]?)"
            r"(?<![A-Za-z0-9+/_.@!#$%^*~?-])(?=[^\s\"'`=]*[A-Za-z0-9])")
#: What is assigned to such a name, whatever its length and digits: all up to
#: the closing quote of the same line, or what no white space or bracket ends
#: before.
VALUE = (r"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)"
         r"|[^\s\"'`=,;&<>(){}\[\]]*[^\s\"'`=,;&<>(){}\[\].:?](?:" + PADDING + ")?)")
#: Runs of key characters: 16 of them with a digit, or a known format.  A run
#: without a digit among its first FAR ones is taken whole too and left out by
#: :func:`_fitting` if it has none further on.
FAR = 64
RUN = (r"(?:[A-Za-z0-9](?:(?<=[0-9])|(?=[A-Za-z+/_.@-]{0," + str(FAR) + r"}+[0-9]))"
       r"(?:[A-Za-z0-9+/_.@-]{14,}[A-Za-z0-9](?:[+/]*" + PADDING + r")?"
       r"|[A-Za-z0-9+/_.@-]{13,}" + PADDING + r")"
       r"|(?=" + ISSUED + r")[A-Za-z0-9][A-Za-z0-9+/_.@-]*[A-Za-z0-9]"
       r"|[A-Za-z0-9][A-Za-z0-9+/_.@-]{" + str(FAR) + r",}[A-Za-z0-9](?:[+/]*" + PADDING + r")?)")
CANDIDATE = PRIVATE_KEY + r"|(?<![A-Za-z0-9])(?=\S)(?:" + ASSIGNED + VALUE + "|" + RUN + ")"
#: Formats that are no secrets: numbers, UUIDs, and, where they hold no run as
#: in a key, addresses, hosts with a path and file names.
PLAIN = r"^(?:[0-9.+/_=-]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
PLACE = (r"^(?:[A-Za-z0-9+_.-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
         r"|(?:[a-z]{1,12}://)?[a-z0-9-][a-z0-9.-]*\.[a-z]{2,6}(?::[0-9]+)?(?:/.*)?"
         r"|[A-Za-z0-9_./-]+\.[a-z]{2,4})$")
TEST_PATH = r"test|example|sample|mock|fixture|doc"
#: Characters of text looked at on either side.
SIDE = 40
#: Most labelled findings in the fit, by the smallest hash.
LABELLED = 20_000
TREES, TREE_DEPTH, SEED = 30, 6, 1

FEATURES = ("length", "transitions", "distinct", "entropy", "digits", "hex", "coverage",
            "slashes", "dots", "path_depth", "path_test", "assigned", "quoted",
            "secret_word", "other_word")


def dictionary(spark, path: str | None = None) -> DataFrame:
    """``word``: whole words of at least four letters of a public vocabulary
    (bounded by that file; it is read on the driver)."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted(t[:-4] for t in vocab
                   if t.endswith("</w>") and t.isascii() and t[:-4].isalpha() and len(t) >= 8)
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias("word"))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row a candidate: row, doc_id, path, text_key, nth (its place among the
    matches of CANDIDATE), candidate, left, right, start (characters before it)."""
    key = F.xxhash64("doc_id", "text")
    parts = (docs.filter(F.col("text").rlike(CANDIDATE))
             .select("doc_id", F.col(path).alias("path"), key.alias("text_key"),
                     F.monotonically_increasing_id().alias("row"),
                     F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
                     F.split("text", CANDIDATE, -1).alias("between")))
    each = parts.select(
        "row", "doc_id", "path", "text_key",
        F.posexplode(F.arrays_zip("found", F.slice("between", F.lit(1), F.size("found"))
                                  .alias("before"),
                                  F.concat(F.array(F.lit("")), "found").alias("last"),
                                  F.slice("between", F.lit(2), F.size("found")).alias("after"))
                     ).alias("nth", "z")).filter("z.found IS NOT NULL")
    before = Window.partitionBy("row").orderBy("nth")
    rows = each.select("row", "doc_id", "path", "text_key", "nth",
                       F.col("z.found").alias("candidate"),
                       # a name can be the candidate before its value
                       F.expr(f"right(concat(z.last, z.before), {SIDE})").alias("left"),
                       F.expr(f"left(z.after, {SIDE})").alias("right"),
                       F.length("z.before").alias("gap"))
    # the row numbers hold in the written table only
    rows = cut_lineage(rows)
    return rows.withColumn("start", (
        F.sum(F.col("gap") + F.length("candidate")).over(before)
        - F.length("candidate")).cast("long")).drop("gap").filter(
            _fitting(F.col("candidate"), F.col("left")))


def harmless(c: Column) -> Column:
    """Whether a candidate is of a format that is no secret."""
    key_run = F.exists(F.split(c, "[^A-Za-z0-9]+"), lambda x: (F.length(x) >= 16)
                       & x.rlike("[0-9]") & x.rlike("[A-Za-z]")) \
        | F.exists(F.split(c, "[^A-Za-z]+"), lambda x: (F.length(x) >= 20)
                   & x.rlike("[a-z]") & x.rlike("[A-Z]"))
    return c.rlike(PLAIN) | (c.rlike(PLACE) & ~key_run)


def phrase(c: Column, left: Column) -> Column:
    """Whether a candidate is a quoted value of a name for a pass phrase."""
    return (left.rlike(PHRASE) & (F.length(c) >= 6) & ~c.rlike(NO_PHRASE))


def _fitting(c: Column, left: Column) -> Column:
    """Whether a match of CANDIDATE is one: of its longest runs those that have
    a digit after all or are assigned."""
    return ((F.length(c) <= FAR) | c.rlike("[0-9]") | c.rlike(ISSUED)
            | F.concat(left, F.lit("x")).rlike(ASSIGNED + "x$"))


def entropy(text: Column) -> Column:
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))
    share = F.transform(letters, lambda c: 1 - F.length(F.replace(text, c, F.lit(""))) / F.length(text))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (with candidate, left, right, path) and the FEATURES."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    around = F.lower(F.concat_ws(" ", F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))))
    path = F.lower(F.coalesce("path", F.lit("")))
    # distinct candidates' letter runs against the dictionary
    runs = (found.select("candidate").distinct()
            .select("candidate", F.explode(F.expr(
                r"regexp_extract_all(candidate, '[A-Z]?[a-z]{3,}|[A-Z]{4,}', 0)")).alias("run"))
            .withColumn("word", F.lower("run")))
    covered = (runs.join(F.broadcast(words), "word")  # bounded by the vocabulary file
               .groupBy("candidate").agg(F.sum(F.length("run")).alias("_covered")))
    out = found.join(covered, "candidate", "left")
    return out.withColumns({
        "length": n,
        "transitions": F.regexp_count(c, F.lit(
            r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
            r"|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "entropy": entropy(c),
        "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "coverage": F.coalesce("_covered", F.lit(0)) / n,
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "dots": F.regexp_count(c, F.lit(r"\.")).cast("double"),
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "path_test": path.rlike(TEST_PATH).cast("double"),
        "assigned": F.coalesce("left", F.lit("")).rlike(r"[:=]\s*[\"'`]?$").cast("double"),
        "quoted": F.coalesce("left", F.lit("")).rlike(r"[\"'`]$").cast("double"),
        "secret_word": around.rlike(SECRET_WORDS).cast("double"),
        "other_word": around.rlike(OTHER_WORDS).cast("double"),
    }).drop("_covered")


def confirmed(found: DataFrame) -> DataFrame:
    """The clear cases of candidates with features, as ``label`` 1 or 0: known
    key formats, and mixed strings assigned to a word for a secret; harmless
    formats, dictionary words and one repeated character."""
    c = F.col("candidate")
    plain = harmless(c) | (F.col("coverage") > 0.6) | (F.col("entropy") < 1.5)
    good = c.rlike(ISSUED) | ((F.col("assigned") == 1) & (F.col("secret_word") == 1)
                              & (F.col("other_word") == 0) & (F.col("digits") > 0.1)
                              & (F.col("digits") < 0.95) & (F.col("entropy") > 3))
    return (found.withColumn("label", F.when(c.rlike(ISSUED) | phrase(c, F.col("left")), 1.0)
                             .when(plain, 0.0).when(good, 1.0))
            .filter("label IS NOT NULL"))


def fit_forest(labelled: DataFrame, most: int = LABELLED):
    """The forest, from at most ``most`` distinct labelled findings of each
    label; None unless both labels occur."""
    rows = labelled.select("label", *FEATURES).distinct()
    by_hash = rows.withColumn("_h", F.xxhash64(F.lit(SEED), *FEATURES))
    # the smallest hashes of each label: a bounded top list, not a window over all
    picked = [by_hash.filter(F.col("label") == y).orderBy("_h", *FEATURES).limit(most)
              for y in (0.0, 1.0)]
    sample = cut_lineage(picked[0].union(picked[1]).drop("_h"))
    if len(sample.select("label").distinct().collect()) < 2:
        return None
    sample = sample.repartition(1).sortWithinPartitions("label", *FEATURES)  # bounded: 2 x most
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="_x"),
        RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=TREES,
                               maxDepth=TREE_DEPTH, seed=SEED, probabilityCol="_p",
                               rawPredictionCol="_raw", predictionCol="_y")]).fit(sample)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source",
         words: DataFrame | None = None) -> DataFrame:
    """One row a candidate of ``docs`` (doc_id, text, ``path``): doc_id, nth,
    start, length, rule, probability, secret, text_key, candidate.

    ``labelled``: findings with candidate, left, right, path and label (1
    secret, 0 not); without, the clear cases of ``docs`` themselves.  Where
    both labels are not there, every candidate of a harmless format or of
    dictionary words alone is let go and the rest kept.  A null or empty text has
    no candidate; repeated rows have theirs each, in the order of the text; a
    null path is an empty one.  A text of any length is scanned whole, and a run
    of any length is one candidate.  An unquoted pass phrase is taken up to its
    first white space."""
    docs = take_columns(docs, "doc_id", "text", path)
    words = words if words is not None else dictionary(docs.sparkSession)
    found = cut_lineage(features(candidates(docs, path), words))
    known = confirmed(found) if labelled is None else features(labelled, words)
    model = fit_forest(known)
    if model is None:
        plain = (F.col("digits") == 0) & (F.col("coverage") > 0.6)
        scored = found.withColumn("probability", F.when(
            harmless(F.col("candidate")) | plain, 0.0).otherwise(1.0))
    else:
        scored = model.transform(found).withColumn("probability", vector_to_array("_p")[1])
    rule = (F.when(F.col("candidate").rlike(ISSUED), "issued_key")
            .when(phrase(F.col("candidate"), F.col("left")), "pass_phrase")
            .when((F.col("hex") == 1) & (F.col("digits") < 1), "hex").otherwise("key_string"))
    return scored.select(
        "doc_id", "nth", "start", F.length("candidate").alias("length"), rule.alias("rule"),
        F.round("probability", 6).alias("probability"),
        ((F.col("probability") >= 0.5) | rule.isin("issued_key", "pass_phrase")).alias("secret"), "text_key", "candidate")


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; columns as before.  Only
    rows with a candidate are moved to meet their findings."""
    docs, restored = with_plain_names(docs, "doc_id", "text")
    key = F.xxhash64("doc_id", "text")
    # rows with equal id and text have equal findings: one list for all
    said = (findings.filter("secret").groupBy("text_key", "doc_id", "nth").count()
            .groupBy("text_key").agg(F.sort_array(F.collect_list("nth")).alias("_nth"))
            .select("text_key", F.flatten(F.transform("_nth", lambda x, i: F.concat(
                F.array_repeat(F.lit(False), x - F.coalesce(F.get("_nth", i - 1), F.lit(-1)) - 1),
                F.array(F.lit(True))))).alias("_put")))
    matches = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    holds = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    rows = docs.filter(holds).withColumn("_text_key", key)
    between = F.split("text", CANDIDATE, -1)
    put = F.concat(F.transform(matches, lambda x, i: F.when(
        F.get("_put", i), mark).otherwise(x)), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, b))), "")
    masked = (rows.join(said, rows["_text_key"] == said["text_key"], "left")
              .withColumn("text", F.when(F.col("_put").isNull(), F.col("text")).otherwise(text))
              .select(*docs.columns))
    return restored(docs.filter(~holds).unionByName(masked))


def secret_scan(spark, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's verdict; a secret is
    named by its SHA-256 only."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return scan(docs).select("doc_id", "start", "length", "rule", "probability", "secret",
                             F.sha2("candidate", 256).alias("candidate_sha256"))
