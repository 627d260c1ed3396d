"""Training flows compute the answers behind their rows once."""

from pyspark.sql import functions as F

from papersieve.plans import training as TRN

FE = ["a", "b"]


def counted(spark):
    acc = spark.sparkContext.accumulator(0)

    def seen(x):
        acc.add(1)
        return x
    look = F.udf(seen, "double").asNondeterministic()
    rows = spark.createDataFrame([(float(i % 2), float(i % 3 > 0), int(i % 4 == 0), i % 5)
                                  for i in range(40)], "a double, b double, label int, fold int")
    return rows.withColumn("a", look("a")), acc


def test_fold_patterns_read_rows_once(spark):
    rows, acc = counted(spark)
    train, held = TRN.fold_patterns(rows, FE)
    assert train.agg(F.sum("n")).first()[0] == 4 * 40 and held.agg(F.sum("n")).first()[0] == 40
    assert acc.value == 40


def test_final_fit_reads_rows_once(spark):
    rows, acc = counted(spark)
    assert TRN.fit_final(rows, FE, {}).count() > 0
    assert acc.value == 40
