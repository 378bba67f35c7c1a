import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from heddle.llm import quality
from heddle.llm.quality import CLASSES, class_counts, judged, measures

DOC = "doc_id long, text string, lang string, hash string, kept int"
WORD = re.compile("[^\x20\x09-\x0d]+")
DIR = "/root/testdata/sf0.01"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)


def brute(docs):
    """Every column, from the whole texts with plain dictionaries."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: [w.translate(low) for w in WORD.findall(t or "")]
    copies, known = Counter((lang or "", t or "") for _, t, lang, *_ in docs), {}
    by_lang = defaultdict(list)
    for (lang, t), n in copies.items():
        by_lang[lang].append((t, n))
    for lang, texts in by_lang.items():
        once, often, classes = Counter(), Counter(), Counter()
        for t, n in texts:
            for w, k in Counter(of(t)).items():
                once[w] += k
                often[w] += k * n
            classes.update(kind(c) for c in t)
        a, b = once.total(), often.total()
        common = {w: k / a for w, k in once.items() if k * 500 >= a and often[w] * 500 >= b}
        known[lang] = ({c: classes[c] / max(1, classes.total()) for c in CLASSES}, common, a)

    def distance(p, q, n):
        mean = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        d = sum(x[k] * math.log2(x[k] / mean[k]) for x in (p, q) for k in x if x[k] > 0) / 2
        return math.sqrt(max(0, d - (sum(v > 0 for v in q.values()) - 1) / (8 * math.log(2) * n)))

    out = []
    for i, t, lang, *_ in docs:
        classes, common, size = known[lang or ""]
        n, *rest = base(t)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        chars = words = None
        if size >= quality.LEAST_REFERENCE:
            if len(t or "") >= quality.LEAST_CHARS:
                chars = distance({k: v / len(t) for k, v in Counter(map(kind, t)).items()}, classes, len(t))
            if n >= quality.LEAST_JUDGED:
                own = Counter(w if w in common else None for w in of(t))
                words = distance({k: v / n for k, v in own.items()}, common | {None: 1 - sum(common.values())}, n)
        kept = not failed and not (chars is not None and chars > quality.CHARS_FAR) and not (words is not None and words > quality.WORDS_FAR)
        out.append((i, n, *rest, failed, kept, chars, words))
    return out


def kind(c):
    if c.isupper() and c.isalpha():
        return "upper"
    if c.isalpha() and c.islower() and c not in "ªº":
        return "lower"
    if c.isalpha():
        return "letter"
    return "digit" if c.isdecimal() else "space" if c in " \t\n\r\x0b\x0c" else "mark" if c in ".,;:!?'\"()-" else "other"


def test_measures_against_brute_force():
    rng = random.Random(5)
    bits = ["a", "b", "the", "É", "\n", "#", "<x>", " ", "&&", "中", "\x0b", "\t"]
    for _ in range(400):
        text = " ".join(rng.choices(bits, k=rng.randint(0, 40)))
        assert measures(text)[1] == base(text), text
    assert measures(None)[1] == (0, 0, 0, 0, 0)
    assert class_counts("Aa1 .#é中").tolist() == [1, 2, 1, 1, 1, 1, 1]


def made():
    rng = random.Random(6)
    rows = []
    for lang, stops in (("en", ["the", "of", "and", "to"]), ("de", ["der", "und", "die"]), (None, ["x", "y"])):
        letters = "abcdefghijkl" if lang == "en" else "äöümnopq"
        for _ in range(60):
            words = [rng.choice(stops) if rng.random() < 0.4 else "".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(rng.randint(5, 200))]
            rows.append((" ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words), lang))
    rows += [(" ".join(f"{''.join(rng.choices('abcdef', k=6))}### &&&" for _ in range(90)), "en"), ("THE AND OF " * 3 + " ".join("".join(rng.choices("ABCDEF", k=5)) + "!!" for _ in range(90)), "en")]
    rows += [("word " * 80, "en"), (None, "en"), ("", None), ("a few words only", "sw"), ("a" * 5000, "en")] + rows[:1] * 40
    return [(i % 90 if i % 7 else None, t, lang, "h", 1) for i, (t, lang) in enumerate(rows)]


def same(got, want):
    for g, w in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert g[:8] == w[:8] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-7) for a, b in zip(g[8:], w[8:], strict=True)), (g, w)


def test_all_columns_against_brute_force(spark):
    docs = made()
    got = judged(spark.createDataFrame(docs, DOC).repartition(5)).collect()
    same(got, brute(docs))
    by_text = {t: r for t, r in zip((d[1] for d in docs), brute(docs), strict=True)}
    assert not any(r[7] for t, r in by_text.items() if t and ("###" in t or "!!" in t))


def test_empty_table_and_one_language(spark):
    df = spark.createDataFrame(made()[:60], DOC)
    assert judged(df.limit(0)).count() == 0
    assert judged(df.withColumn("doc_id", df.doc_id.cast("string")), lang_col=None).count() == 60


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_junk_goes_and_the_rest_stays(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = judged(docs).join(labels, "doc_id").select("kept", "quality").collect()
    bad, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
