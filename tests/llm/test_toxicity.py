import random
import zlib

import numpy as np

from heddle.llm import toxicity as T

DOC, LABEL = "doc_id long, text string, score string, __text int", "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        w, toxic = rng.choices(vocab, k=rng.choice([5, 40, 200])), i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(["GRUFF", "snark", "öde"])
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_gradients_against_differences():
    net = T.Network(3, np.float64)
    rng = np.random.default_rng(1)
    x, want = rng.normal(size=(3, 6, T.DIM)), np.array([1.0, 0.0, 1.0])
    mask = np.arange(6)[None, :] < np.array([6, 4, 1])[:, None]
    g, dx, _ = net.gradients(x, mask, want)
    loss = lambda: net.gradients(x, mask, want)[2]
    for name, grad in [*g.items(), ("x", dx)]:
        values = x if name == "x" else net.p[name]
        for at in rng.choice(values.size, min(values.size, 6), replace=False):
            old = values.flat[at]
            values.flat[at] = old + 1e-6
            up = loss()
            values.flat[at] = old - 1e-6
            down = loss()
            values.flat[at] = old
            assert abs((up - down) / 2e-6 - grad.flat[at]) < 1e-5, name


def test_windows_cover_all_words():
    for n in range(0, 300):
        starts = T.windows_of(n)
        seen = {i for s in starts for i in range(s, min(n, s + T.WINDOW))}
        assert seen == set(range(n)) and (n <= T.WINDOW or starts[-1] + T.WINDOW == n)


def test_scores_do_not_depend_on_neighbours():
    net = T.Network(2)
    texts = [None, b"", b"one", ("wörd " * 31).encode(), b"a b " * 900, b"x" * 5000, b"GRUFF it"]
    all_, _ = T.scores(net, texts)
    for t, s in zip(texts, all_, strict=True):
        assert abs(T.scores(net, [t])[0][0] - s) < 1e-5 and 0 <= s <= 1


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(500)
    docs += [(900, None, None, None), (None, "gruff", None, None), (901, "", None, None), (901, "", None, None), (902, "w1 " * 20000 + "snark", None, None)]
    labels += [(900, None, None), (None, 1, 1), (3, 1, None), (4, 1, 7), (0, 1, 1)]
    out = T.score_toxicity(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert len(out) == len(docs)
    right = []
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id < 500:
            right.append(r.predicted == int(r.doc_id % 4 == 0))
    assert np.mean(right) > 0.95
    assert [r.predicted for r in out if r.doc_id == 902] == [1]


def test_filter_keeps_columns_and_no_labels(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, DOC).drop("__text")
    kept = T.without_toxic(frame, spark.createDataFrame(labels, LABEL))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i in range(300) if i % 4}
    assert len(ids & clean) > 0.97 * len(clean) and len(ids - clean) < 8
    none = spark.createDataFrame([], LABEL)
    assert len(set(r.score for r in T.score_toxicity(frame, none).collect())) == 1
    assert T.score_toxicity(frame.limit(0), none).collect() == []


def test_filter_keeps_columns_with_names_of_its_own_and_empty_tables(spark):
    docs, labels = corpus(200)
    frame = spark.createDataFrame([(i, t, "mine", i * 2, [1.5]) for i, t, *_ in docs], "doc_id long, text string, __text string, __Score long, __worst array<double>")
    held = spark.createDataFrame(labels, LABEL)
    kept = T.without_toxic(frame, held)
    assert kept.columns == frame.columns and {(r["__text"], r["__Score"] - 2 * r.doc_id, tuple(r["__worst"])) for r in kept.collect()} == {("mine", 0, (1.5,))}
    assert T.without_toxic(frame.limit(0), held).collect() == []


def test_ids_with_both_labels_are_left_out(spark, monkeypatch):
    got = []
    monkeypatch.setattr(T, "train", lambda texts, labels, seed=1: got.append(sorted(zip(texts, labels, strict=True))))
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    labels = [(i, 1, k % 2) for k, i in enumerate(ids)] + [(ids[0], 1, 1), (ids[1], 0, 1)]
    T.fit(spark.createDataFrame([(i, f"t{i}", "", 1) for i in ids], DOC), spark.createDataFrame(labels, LABEL))
    assert got == [sorted((f"t{i}".encode(), k % 2) for k, i in enumerate(ids) if k)]


def test_one_passage_of_a_long_text_is_learnt(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(240):
        w = [f"w{rng.randrange(400)}" for _ in range(1500)]
        if i % 2:
            at = rng.randrange(1490)
            w[at : at + 6] = rng.choices(["GRUFF", "snark", "öde"], k=6)
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, 1, i % 2))
    out = T.score_toxicity(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in out if r.held_out]) > 0.9


def test_short_passages_are_whole_in_a_window():
    for n in (33, 100, 257):
        starts = T.windows_of(n)
        for size in range(1, 17):
            assert all(((starts <= at) & (at + size <= starts + T.WINDOW)).any() for at in range(n - size + 1))


def test_an_id_with_many_rows_does_not_go_to_the_driver_whole(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_CLASS", 8)
    got = []
    monkeypatch.setattr(T, "train", lambda texts, labels, seed=1: got.append((texts, labels)))
    own = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = [(own[0], f"text {k % 100}", "", 1) for k in range(300)] + [(i, f"other {i}", "", 1) for i in own[1:]]
    labels = [(i, 1, int(i == own[0])) for i in own]
    T.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL))
    (texts, kinds), = got
    assert sum(kinds) == 8 and len(kinds) == 8 + 3 and len(set(texts)) == len(texts)


def plain_score(net, text):
    """Score and first word of the worst window, word by word in plain Python."""
    import math

    from heddle.llm.base import words_of
    from heddle.llm.toxicity import HIDDEN, STRIDE, WINDOW, word_inputs

    p = {k: v.astype(float).tolist() for k, v in net.p.items() if k not in ("words", "chars")}
    h, s, e = words_of(text or b"")
    vectors = []
    for i in range(len(h)):
        one, two, grams, _ = word_inputs(text, s[i : i + 1], e[i : i + 1], h[i : i + 1])
        chars = [net.p["chars"][g].astype(float) for g in grams.tolist()]
        vectors.append([float(a) + float(b) + sum(float(c[k]) for c in chars) / len(chars) for k, (a, b) in enumerate(zip(net.p["words"][one[0]], net.p["words"][two[0]], strict=True))])
    times = lambda v, m: [sum(v[i] * m[i][j] for i in range(len(v))) for j in range(len(m[0]))]
    sig = lambda x: 1 / (1 + math.exp(-x))

    def states(xs, d):
        out, state = [], [0.0] * HIDDEN
        for x in xs if d == "f" else xs[::-1]:
            a, b = [y + z for y, z in zip(times(x, p["W" + d]), p["b" + d], strict=True)], times(state, p["U" + d])
            z = [sig(a[k] + b[k]) for k in range(HIDDEN)]
            r = [sig(a[k] + b[k]) for k in range(HIDDEN, 2 * HIDDEN)]
            new = [math.tanh(a[2 * HIDDEN + k] + r[k] * b[2 * HIDDEN + k]) for k in range(HIDDEN)]
            state = [new[k] + z[k] * (state[k] - new[k]) for k in range(HIDDEN)]
            out.append(state)
        return out if d == "f" else out[::-1]

    def logit(xs):
        if not xs:
            return p["c"][0]
        own = [f + b for f, b in zip(states(xs, "f"), states(xs, "b"), strict=True)]
        told = [sum(v * math.tanh(x) for v, x in zip(p["v"], times(t, p["A"]), strict=True)) for t in own]
        top = max(told)
        weights = [math.exp(t - top) for t in told]
        pooled = [sum(w * t[k] for w, t in zip(weights, own, strict=True)) / sum(weights) for k in range(2 * HIDDEN)]
        return sum(a * b for a, b in zip(pooled, p["u"], strict=True)) + p["c"][0]

    n = len(vectors)
    starts = [0] if n <= WINDOW else sorted({*range(0, n - WINDOW, STRIDE), n - WINDOW})
    found = [(logit(vectors[a : a + WINDOW]), a) for a in starts]
    best = max(v for v, _ in found)
    return sig(best), next(a for v, a in found if v == best), len(found)


def test_scores_against_plain_python():
    import numpy as np

    from heddle.llm.toxicity import Network, scores

    rng = np.random.default_rng(3)
    net = Network(5)
    net.p["words"] = rng.normal(size=net.p["words"].shape).astype(np.float32) * np.float32(0.5)
    net.p["c"][:] = 0.3
    words = ["the", "idiot", "été", "and", "x", "thandea", "12"]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (1, 5, 31, 32, 33, 47, 48, 49, 100, 161)] + [None, b"", b" . "]
    got, where = scores(net, texts)
    for text, score, place in zip(texts, got, where, strict=True):
        want, at, _ = plain_score(net, text)
        assert abs(score - want) < 1e-4 and (place == at or not text), text
