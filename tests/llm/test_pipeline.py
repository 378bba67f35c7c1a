import hashlib

import corpus_pipeline as P
import numpy as np
from tokenizers import Tokenizer

from heddle.llm.queries import word_bpe_path
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_minhash import brute as brute_first
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_toxicity import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = corpus(300)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in docs]
    rows += [(1000, rows[41][1] + " token = abcdefgh", "en", "s", 9), (1001, f"so {item} it goes", "de", "s", 9), (1002, rows[41][1], "en", "s", 9), (1003, None, None, None, None), (1004, "", None, "s", 0)]
    rows += [(1005, "a secret: hunter22 lies here among other words", "en", "s", 9), rows[50]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        held[name] = [tuple(r) for r in frame.collect()]
        assert name == "encoding" or frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i in range(300) if i % 4 == 0}
    kept = {r[0] for r in held["toxicity"]}
    assert len(kept & toxic) < 10 and len(kept - toxic) > 0.95 * (len(rows) - 76)
    assert sorted((r[0] for r in held["near duplicates"]), key=str) == brute_first(held["toxicity"])
    clean = sorted(i for i, _, n, *_ in brute_hits(held["near duplicates"], [(1, item)]) if not n)
    assert sorted(r[0] for r in held["decontamination"]) == clean and 1001 not in clean
    masked = {r[0]: r for r in held["secrets"]}
    assert sorted(masked) == clean and masked[1005][1] == "a [secret] lies here among other words" and masked[1005][4] == 38
    for r in held["decontamination"]:
        assert not brute_secrets(masked[r[0]][1] or "") and (brute_secrets(r[1] or "") or masked[r[0]][:4] == r[:4])
    theirs = Tokenizer.from_file(word_bpe_path())
    for doc, n, ids_sha, _, ids in held["encoding"]:
        own = theirs.encode(masked[doc][1] or "", add_special_tokens=False).ids
        assert ids == own and n == len(own) and ids_sha == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
    assert sorted(tuple(r) for r in P.run(spark, str(tmp_path)).collect()) == sorted(held["encoding"])
