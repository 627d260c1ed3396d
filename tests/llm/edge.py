"""A small documents table with every awkward row, and extra columns whose
names clash but for case or with the operators' own."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(n, step=1, shift=0):
    return " ".join(WORDS[(i * step + i // 7 + shift) % 12] + str(i % 5) for i in range(n))


ROWS = [
    (0, prose(60), "en", "a", 1), (1, prose(60), "en", "a", 1), (1, prose(60), "en", "a", 1),
    (2, prose(60) + " tail", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 3), (6, "one", "de", "c", 3), (7, "ONE", "de", "c", 3),
    (8, "one two", "de", None, 7), (None, prose(55, 5), "fr", "c", 9),
    (None, None, None, "c", None), (9, prose(30000, 3, 1), "en", "a", 9),
    (10, "x" * 5000, "en", "a", 5000), (11, "é中🙂 <|endoftext|> ßİ 'S 12", "fr", "d", 20),
    (12, "line\nline\nline\n\n", "en", "d", 16),
    (13, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" idiot', "en", "d", 9),
]


def documents(spark, rows=ROWS):
    """ROWS with extra columns, clashing in case with the real ones."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("TEXT", "Doc_ID", "node", "_key", "shard", "copies", "score", "kept", "part"):
        df = df.select("*", F.lit("extra").alias(name)) if name not in df.columns else df
    return df


def empty(spark):
    return documents(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
