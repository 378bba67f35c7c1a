"""Row numbers stay the same when later jobs cut the input files into other partitions."""

import pytest

from heddle.llm import decontaminate, queries, simhash, suffix_dedup
from tests.llm.test_suffix_dedup import brute, corpus

SPLITS = {"spark.sql.files.openCostInBytes": ("1g", "1"), "spark.sql.files.maxPartitionBytes": ("1g", "100g"), "spark.sql.files.minPartitionNum": ("1", "1")}


@pytest.fixture
def replanned(spark, monkeypatch):
    """Makes a module's tables change how files are cut as soon as one of that tag is written."""
    old = {k: spark.conf.get(k, None) for k in SPLITS}

    def at(module, tag):
        write = module.written

        def written(df, name):
            out = write(df, name)
            if name == tag:
                for k, v in SPLITS.items():
                    spark.conf.set(k, v[1])
            return out

        monkeypatch.setattr(module, "written", written)
        for k, v in SPLITS.items():
            spark.conf.set(k, v[0])

    yield at
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_op9_suffix_dedup(spark, monkeypatch, replanned, tmp_path):
    monkeypatch.setattr(suffix_dedup, "BATCH_ROWS", 7)
    rows = corpus(4, 100)
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    replanned(suffix_dedup, "anchors")
    out = queries.op9_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute(rows)


def test_stages_of_the_pipeline(spark, replanned, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, item if i % 5 == 0 else f"text of its own {i // 2} and more", i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(8).write.parquet(str(tmp_path / "d"))
    replanned(decontaminate, "hit")
    docs, items = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()) == [i for i in range(60) if i % 5]
    replanned(simhash, "sets")
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect()) == sorted(first.values())
