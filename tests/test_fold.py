from pyspark.sql import functions as F

from millrace.functions import text as tx


def test_plain_texts_skip_the_fold_table(spark):
    df = spark.createDataFrame([("Ab C_1",), ("Ação",), ("",), (None,)], "t string")
    out = df.select(tx.fold(F.col("t")).alias("f"))
    assert [r.f for r in out.collect()] == ["ab c_1", "acao", "", None]
    assert "CASE WHEN (octet_length" in out._jdf.queryExecution().optimizedPlan().toString()
