"""Every stage of the pipeline against a plain version of its rule, on texts where candidates can't be missed."""

import hashlib
import random
from itertools import combinations

import pytest

from tomeflow.llm import line_dedup, minhash, quality
from tomeflow.llm._words import Words

from .conftest import words
from .test_dedup import classes
from .test_filters import judged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCHMARK = [(1, " ".join(words(900, 40))), (2, " ".join(words(901, 9)))]


def corpus():
    r, rows = random.Random(12), []
    for i in range(30):
        lines = [" ".join(words(100 * i + k, r.randint(8, 20))) for k in range(4)]
        if i % 5 == 1:
            lines[2] = lines[2].upper() + "!!!!"
        rows.append((i, lines))
    for i in range(30, 45):  # near copies, with a letter changed in one line
        lines = list(rows[i - 30][1])
        lines[1] = "q" + lines[1][1:]
        rows.append((i, [*lines, " ".join(words(7_000 + i, 12))]))
    rows += [(50, [BENCHMARK[0][1]]), (51, ["some text before", " ".join(words(950, 15)) + " " + BENCHMARK[1][1]]), (52, ["own words here", *[" ".join(words(960 + k, 30)) for k in range(12)], BENCHMARK[0][1][:70]])]
    rows += [(60 + i, [("BUY NOW!!! " * 12).strip() + f" {w}" for w in words(80 + i, 2)]) for i in range(20)]
    found = [(i, "\n".join(x)) for i, x in rows] + [(90, None), (91, ""), (None, "a text without a number of its own here"), (92, "same text"), (92, "same text")]
    return [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in found]


def lines_left(rows):
    """Lines grouped by equal words or edit similarity; the first by (doc_id, digest, place) stays."""
    places = [(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), k, line_dedup.normal(x)) for i, t, *_ in {(r[0], r[1]): r for r in rows}.values() for k, x in enumerate((t or "").split("\n"))]
    places = sorted(p for p in places if p[4])
    near = [(a, b) for a, b in combinations(range(len(places)), 2) if line_dedup.within(places[a][4], places[b][4], int(0.15 * max(len(places[a][4]), len(places[b][4])) + 1e-9))]
    gone = {places[k][:4] for k, c in enumerate(classes(len(places), near)) if c != k}
    out = []
    for i, t, lang, source, n in rows:
        key = (i is None, i or 0, hashlib.md5((t or "").encode()).digest())
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (*key, k) not in gone)
        out.append((i, kept, lang, source, n if kept == t else len(kept)))
    return out


def one_of_each(rows):
    """One row of each group of texts with a shingle overlap of 0.8; the least doc_id, then digest, then any of equal rows."""
    distinct = list({(r[0], r[1] or ""): r for r in rows}.values())
    distinct.sort(key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest(), r[1] is None))
    bags = [minhash.multiset(Words([r[1] or ""]).hashes) for r in distinct]
    near = [(a, b) for a, b in combinations(range(len(distinct)), 2) if (distinct[a][1] or "") == (distinct[b][1] or "") or (bags[a][1].sum() and bags[b][1].sum() and minhash.overlap(bags[a], bags[b]) >= 0.8)]
    return [r for k, (r, c) in enumerate(zip(distinct, classes(len(distinct), near))) if c == k]


def order(rows):
    return sorted(rows, key=repr)


def test_each_stage_against_its_rule(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 80), 0) for i in [*range(30), *range(60, 75)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stage = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(pipeline.STAGES)

    def through(name, docs):
        out = stage[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        found = spark.read.parquet(f"{tmp_path}/{name}")
        return found, order(tuple(r) for r in found.collect())

    keep = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    docs, found = through("quality_classifier", docs)
    assert found == order(r for r in rows if keep[r[0]]) and not any(r[0] and 60 <= r[0] < 80 for r in found) and len(found) >= len(rows) - 20
    want = lines_left(found)
    docs, found = through("line_dedup", docs)
    assert found == order(want) and any(r[1] == "" for r in found)
    want = one_of_each(found)
    docs, found = through("near_dedup", docs)
    assert [r[0] for r in found] == [r[0] for r in order(want)] and [r[1] or "" for r in found] == [r[1] or "" for r in order(want)]
    bad = {x[0] for x in judged([r[:2] for r in found], BENCHMARK) if x[-1]}
    assert "50" in bad
    want = [r for r in found if str(r[0]) not in bad]
    docs, found = through("decontaminate", docs)
    assert found == order(want)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in found}
    _, coded = through("bpe", docs)
    assert order((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()) == order(c[:3] for c in coded)
    assert sorted(map(repr, (tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(repr, coded))
