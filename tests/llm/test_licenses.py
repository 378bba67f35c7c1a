import random
import re

from heddle.llm.licenses import PHRASES, TEMPLATES, scan_licenses, stretches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, labels int, row string"


def words(t):
    return WORD.findall((t or "").translate(LOW))


def base(t):
    w, places, labels = words(t), [], set()
    for p, label in PHRASES.items():
        p = p.split()
        for a in range(len(w) - len(p) + 1):
            if w[a : a + len(p)] == p:
                places.append(a)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    rng = random.Random(1)
    bits = ["CC BY", "cc-by", "cc", "by", "General Public License", "general public", "all rights reserved", "All Rights", "reserved.", "x", "é"]
    docs = [(i % 30, " ".join(rng.choices(bits, k=rng.randint(0, 40))), 1, "a") for i in range(50)]
    docs += [(None, None, None, None), (5, "", None, None), (6, "cc by " * 9000, None, None)]
    rows = scan_licenses(spark.createDataFrame(docs, DOC)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert got == sorted(((i, *base(t)) for i, t, *_ in docs), key=str)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_templates_are_found_where_they_stand(spark):
    docs = [(i, f"some words before. {t.upper()} and after, with much else", 0, "") for i, (_, t) in enumerate(TEMPLATES)]
    docs += [(100, TEMPLATES[7][1].replace("binary", "other"), 0, ""), (101, "the license of a public garden, with version and general terms", 0, "")]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, DOC)).collect()}
    for i, (label, t) in enumerate(TEMPLATES):
        assert label in rows[i].labels.split(","), t
        assert rows[i].score == 1 and any(s.label == label and s["first"] == 3 and s.end == 3 + len(words(t)) for s in rows[i].spans)
    assert rows[100].labels == "bsd" and rows[100].score < 1
    assert rows[101].labels == "" and rows[101].score == 0


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], DOC)).collect() == []


def test_labels_are_exactly_those_of_the_notice(spark):
    notices = [(t, {label}) for label, t in TEMPLATES]
    gpl = "licensed under the GNU {}General Public License{}"
    notices += [(gpl.format("", ", version 1"), set()), (gpl.format("", ""), set()), (gpl.format("Affero ", ", version 3"), set())]
    notices += [(gpl.format("Lesser ", f", version {v}"), {"lgpl"}) for v in ("2.1", "3")] + [(gpl.format("", ", version 2 or later"), {"gpl-2.0"})]
    notices += [("subject to the terms of the Mozilla Public License, v. 1.1", set()), ("Licensed under the Apache License, Version 1.1", set()), ("licensed under CC BY-NC-SA 4.0", set()), ("licensed under CC BY 3.0", set())]
    notices += [(TEMPLATES[5][1].replace("GNU", "GNU Lesser"), set())]
    docs = [(i, f"before it {t} after it", 0, "") for i, (t, _) in enumerate(notices)]
    for r in scan_licenses(spark.createDataFrame(docs, DOC)).collect():
        t, want = notices[r.doc_id]
        assert {s.label for s in r.spans or []} == want, t
        assert set(r.labels.split(",")) - {""} == want | set(base(t)[4].split(",")) - {""}, t


def brute_stretches(doc, template):
    """The best cover of a run of the template's grams that follow one another in the document, both growing, on diagonals at most 2 from the first."""
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hits = [(a, p) for a, x in enumerate(grams(doc)) for p, y in enumerate(grams(template)) if x == y]
    best = 0.0
    for a0, p0 in hits:
        reach = {(a0, p0): 3}
        for a, p in sorted(hits):
            steps = [c + min(3, p - q) for (b, q), c in reach.items() if b < a and q < p]
            if steps and abs((a - p) - (a0 - p0)) <= 2:
                reach[a, p] = max(steps)
        best = max(best, max(reach.values()) / len(template))
    return best


def test_stretches_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        template = [rng.choice("abcdefghijkl") for _ in range(rng.randint(6, 14))]
        doc = [rng.choice("abcdefghijkl") for _ in range(5)] + [w for w in template if rng.random() < 0.97 for _ in range(1 + (rng.random() < 0.05))] + [rng.choice("abc")] * 3
        hits = [(a, p) for a in range(len(doc) - 2) for p in range(len(template) - 2) if doc[a : a + 3] == template[p : p + 3]]
        found = stretches(hits, len(template), [])
        assert bool(found) == (brute_stretches(doc, template) >= 0.8), (doc, template)


def test_chained_pieces_are_no_notice(spark):
    docs = [(1, "licensed under cc under cc by cc by 4 by 4 0", 0, ""), (2, "x licensed under CC BY 4.0 and again licensed under CC BY 4.0", 0, ""), (3, "licensed under the " + "the mit license " * 5, 0, "")]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, DOC)).collect()}
    assert rows[1].labels == "cc-by" and rows[1].score == 0.5
    assert [(s["first"], s.end, s.label) for s in rows[2].spans] == [(1, 7, "cc-by-4.0"), (9, 15, "cc-by-4.0")]
    assert not rows[3].spans
