from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from heddle.llm import bpe, decontaminate, licenses, suffix_dedup, warc
from heddle.llm.queries import word_bpe_path


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "decimal(10,2)", "string", "date"])
def test_ids_of_any_type_come_back(spark, kind):
    ids = F.lit("2024-01-05").cast("date") if kind == "date" else F.col("id").cast(kind)
    docs = spark.range(3).select(ids.alias("doc_id"), F.lit("all rights reserved and ten more words that stand in a row of this text").alias("text"))
    items = docs.limit(1).select(F.lit("i").alias("item_id"), "text")
    want = sorted(map(str, (r[0] for r in docs.select("doc_id").collect())))
    for out in (bpe.encode_documents(docs, word_bpe_path()), decontaminate.decontaminate(docs, items), licenses.scan_licenses(docs)):
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        assert sorted(map(str, (r[0] for r in out.select("doc_id").collect()))) == want


def test_ids_that_have_to_be_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "text"), ("b", "text")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        suffix_dedup.remove_repeats(docs)
    with pytest.raises(ValueError, match="whole numbers"):
        warc.archive(spark.createDataFrame([(Decimal(1), "u", "h")], "page_id decimal(10,2), url string, html string"))
    small = spark.createDataFrame([(1, "text " * 30), (2, "text " * 30)], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast("smallint"))
    assert [r.n_removed > 0 for r in suffix_dedup.remove_repeats(small).orderBy("doc_id").collect()] == [False, True]
