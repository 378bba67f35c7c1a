import random

import pytest

import corpus_pipeline as P
from heddle.llm import minhash as M
from heddle.llm.simhash import without_near_duplicates

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Rows that stay: the first, by id, of what pairs of Jaccard 0.8 connect."""
    def own(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, comp = [own(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if comp[i] != comp[j] and (not b or a / b >= 0.8):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    first = {}
    for r, c in sorted(zip(rows, comp, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(c, r[0])
    return sorted(first.values(), key=str)


def corpus(n, seed=3):
    """Texts and copies with words changed at one place, so that the similarity falls on either side of 0.8."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 120, 300]))]
        for _ in range(rng.randint(1, 5)):
            w, k = list(base), int(len(base) * rng.choice([0, 0.02, 0.05, 0.09, 0.1, 0.12, 0.2]))
            at = rng.randrange(len(w) - k + 1)
            w[at : at + k] = [f"v{rng.randrange(5000)}" for _ in range(k)]
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w), "en", "s", i))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_stage_against_brute_force_jaccard(spark, monkeypatch, tmp_path, small):
    if small:
        monkeypatch.setattr(M, "CHUNK", 2)
    rows = corpus(60)
    rows += [(None, None, None, None, None), (900, "", None, None, None), (901, " \n", None, None, None), (None, rows[0][1], "x", "s", 1), rows[1]]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "d"))
    out = P.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert sorted((r.doc_id for r in out), key=str) == brute(rows)


def test_pairs_at_the_bound_share_a_band():
    rng, lost = random.Random(5), 0
    for _ in range(400):
        common = [rng.getrandbits(64) for _ in range(160)]
        a, b = (M.np.unique(M.np.array(common + [rng.getrandbits(64) for _ in range(20)], M.np.uint64)) for _ in range(2))
        lost += not set(M.band_keys(a).tolist()) & set(M.band_keys(b).tolist())
    assert lost == 0


def test_empty(spark):
    assert without_near_duplicates(spark.createDataFrame([], DOC)).collect() == []


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"text {i // 2} of its own", "mine", i, "k") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __row string, row long, __text string")
    out = without_near_duplicates(frame)
    assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == rows[::2]
