"""The quality classifier, decontamination, and the pipeline."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tomeflow.llm import decontaminate, quality

from .conftest import edge_rows, frame, same_but, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def judged(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = tokens(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                if at := windows.get(tuple(w[k : k + length])):
                    hit |= set(range(k, k + length))
                    found |= at
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, " ".join(words(1, 60)[10:40])), (2, "One, two"), (3, " ".join(words(1, 60)[25:45])), (2, "one TWO"), (4, None), (None, "word word"), (5, ""), (6, "word " * 20)]


def test_contamination_against_brute_force(spark, edges):
    docs = edge_rows()
    found = decontaminate.contamination(decontaminate.phrase_matches(decontaminate.build_index(edges, 500), bench(spark, ITEMS)))
    want = judged(docs, [x for x in ITEMS if x[0] is not None and x[1] is not None])
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == want


def test_blocks_of_tests_merge(spark, edges, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    found = decontaminate.contamination(decontaminate.phrase_matches(decontaminate.build_index(edges), bench(spark, ITEMS)))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == judged(edge_rows(), [x for x in ITEMS if x[0] is not None and x[1] is not None])


def test_contamination_of_empty_tables(spark, edges, empty):
    index = decontaminate.build_index(empty)
    assert decontaminate.contamination(decontaminate.phrase_matches(index, bench(spark, ITEMS))).count() == 0
    none = decontaminate.contamination(decontaminate.phrase_matches(decontaminate.build_index(edges), bench(spark, []))).collect()
    assert len(none) == len(edge_rows()) and not any(r.contaminated for r in none)


def test_proximity_finds_scattered_words(spark):
    docs = frame(spark, [(1, "x y alpha z beta q gamma t"), (2, "alpha " + "pad " * 40 + "beta gamma"), (3, "gamma beta alpha")])
    found = decontaminate.proximity_matches(decontaminate.build_index(docs), bench(spark, [(9, "alpha beta gamma")]), slop=4)
    assert {(r.doc_id, r.start, r.stop) for r in found.collect()} == {(1, 2, 7), (3, 0, 3)}


def test_decontaminated_keeps_clean_rows(spark, edges):
    kept = decontaminate.decontaminated(edges, bench(spark, ITEMS[:1]))
    bad = {i for i, *_, c in judged(edge_rows(), ITEMS[:1]) if c}
    assert same_but(kept, edges) and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in edge_rows() if str(i) not in bad)


def labelled_corpus(n=400, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    vocabulary = words(50, 300)
    for i in range(n):
        text = [r.choice(vocabulary) for _ in range(r.randint(20, 200))]
        kind = r.random()
        if kind < 0.15:
            text = [w.upper() + "!!" for w in text]
        elif kind < 0.3:
            for k in range(0, len(text), 12):
                text[k] = r.choice(["nasty", "vile", "rotten"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled_corpus()
    known = spark.createDataFrame(labels[:250] + [(0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.keep for r in quality.classify(frame(spark, rows), known).collect()}
    right = [found[i] == (q == 1 and t == 0) for i, q, t in labels[250:]]
    assert sum(right) / len(right) > 0.95
    kept = quality.kept_documents(frame(spark, rows), known)
    assert same_but(kept, frame(spark, rows)) and {r.doc_id for r in kept.collect()} == {i for i in found if found[i]}


def test_classifier_does_not_depend_on_partitions(spark):
    """Equal scores, with copies of texts under other metadata, however the rows are dealt."""
    rows, labels = labelled_corpus(300)
    rows += [(1000 + i, t) for i, t in rows[:150]]
    known, found = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int"), []
    for n in (1, 4, 7):
        found.append(sorted((r.doc_id, r.p_text, r.p_meta, r.p_reject) for r in quality.classify(frame(spark, rows).repartition(n), known, labelled=120, pseudo=100).collect()))
    assert found[0] == found[1] == found[2]


def test_views_teach_each_other(spark):
    """Words that no labelled row has are learnt from rows that the metadata view is sure of."""
    r, vocabulary = random.Random(8), words(51, 200)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = r.sample(vocabulary, 44)
        if bad:
            text[::11] = ["nasty", "vile", "rotten", "awful"] if i < 150 else ["grim", "dire", "foul", "bleak"]
        rows.append((i, " ".join(text), "dark" if bad else "light"))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("source", F.when(F.col("doc_id") < 500, F.col("source")))
    known = spark.createDataFrame(labels[:150], "doc_id long, quality int, toxic int")
    late = lambda rounds: sum(not x.keep for x in quality.classify(docs, known, rounds=rounds, confident=0.8).where("doc_id >= 500 and doc_id % 3 = 0").collect())
    assert late(2) >= 25 and late(0) == 0


def test_classifier_on_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep and r.p_reject == 0 for r in quality.classify(edges, none).collect())
    some = spark.createDataFrame([(10, 1, 0), (12, 0, 0), (12, 0, 0), (16, 0, 1), (19, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(edges, some).count() == len(edge_rows())
    assert quality.classify(empty, some).count() == 0
    bare = edges.select("doc_id", "text")
    assert quality.classify(bare, some).count() == len(edge_rows())


def test_calibration_is_stable():
    view = quality.View(4)
    view.calibrate({-30.0: (900, 2), -5.0: (50, 3), 0.0: (5, 5), 6.0: (1, 40), 30.0: (0, 300)})
    assert 0 < view.slope < 3 and abs(view.offset) < 3
    view.calibrate({})
    assert (view.slope, view.offset) == (1.0, 0.0)
