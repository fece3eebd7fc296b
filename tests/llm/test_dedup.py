"""Near duplicates, repeated units and lines, and the graph steps under them, against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import lines_once
from tomeflow.llm import _graph, line_dedup, minhash, substring_dedup
from tomeflow.llm._graph import bucket_groups, components
from tomeflow.llm._words import Words, shingles
from tomeflow.llm.queries import op9_line_dedup

from .conftest import edge_rows, frame, same_but, words


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("crowd", [0, 100_000])
def test_members_that_share_buckets_travel_packed(spark, crowd, monkeypatch):
    """All members of buckets with several come through, and a row is dealt for many of them."""
    monkeypatch.setattr(_graph, "CROWD", crowd or 64)
    rng = random.Random(8)
    rows = [(rng.choice([rng.randrange(300) - 150, rng.getrandbits(63), 7]), k) for k in range(3000)]
    members = spark.createDataFrame(rows, "bucket long, id long").repartition(3)
    with _graph.Shelf(spark) as shelf:
        shared = _graph._sharing(shelf, members)
        found = sorted(map(tuple, shared.collect()))
        packed = shared._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    n = Counter(b for b, _ in rows)
    assert found == sorted((b, k) for b, k in rows if n[b] > 1)
    assert packed == 2  # rows are packed before they are dealt
    assert spark.createDataFrame([], "bucket long, id long").transform(lambda x: _graph._sharing(_graph.Shelf(spark), x)).count() == 0


@pytest.mark.parametrize("crowd", [64, 100_000])
def test_buckets_of_a_member_travel_as_one_value(spark, crowd, monkeypatch):
    """Members with packed buckets share what members with a row for each bucket do; no row is made for each before they are dealt."""
    monkeypatch.setattr(_graph, "CROWD", crowd)
    rng = random.Random(9)
    lists = [[rng.choice([rng.randrange(300) - 150, rng.getrandbits(63), 7]) for _ in range(rng.randrange(5))] for _ in range(2000)]
    packed = _graph.packed_keys(np.array([b for x in lists for b in x], np.int64), np.array([len(x) for x in lists])).to_pylist()
    assert packed[:5] == [np.array(x, np.int64).tobytes() for x in lists[:5]]
    members = spark.createDataFrame([(p, k) for k, p in enumerate(packed)] + [(None, 5000)], "buckets binary, id long").repartition(3)
    with _graph.Shelf(spark) as shelf:
        shared = _graph._sharing(shelf, members)
        found = sorted(map(tuple, shared.collect()))
        plan = shared._jdf.queryExecution().optimizedPlan().toString()
    n = Counter(b for x in lists for b in x)
    assert found == sorted((b, k) for k, x in enumerate(lists) for b in x if n[b] > 1)
    assert "Generate" not in plan and (crowd == 64 or plan.count("MapInArrow") == 2)


@pytest.mark.parametrize("each", [5, 1_000])
def test_components_of_chains_and_stars(spark, each):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5), each).collect()}
    assert found == {i: 1 for i in range(2, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), each).count() == 0


@pytest.mark.parametrize(("seed", "most", "crowd"), [(1, 8, 100_000), (2, 20, 0), (3, 1_000, 100_000)])
def test_bucket_groups_lose_nothing(spark, seed, most, crowd, monkeypatch):
    """Points in three buckets, linked within a reach: the same groups as all pairs of a bucket give, in one block or many."""
    monkeypatch.setattr(_graph, "CROWD", crowd)
    r = random.Random(seed)
    at, bucket = [r.randint(0, 150) for _ in range(90)], [r.randint(1, 3) for _ in range(90)]
    bucket[-1] = 4
    points = spark.createDataFrame([(i, str(x)) for i, x in enumerate(at)], "id long, text string")

    def link(texts, i, j, groups):
        for a, b in zip(i.tolist(), j.tolist()):
            if abs(int(texts[a]) - int(texts[b])) <= 2:
                groups.join(a, b)
        yield from ()

    members = spark.createDataFrame([(b, i) for i, b in enumerate(bucket)] + [(5, i) for i in range(6)], "bucket long, id long")
    found = {x.node: x.root for x in bucket_groups(members, lambda ids: points.join(ids, "id"), link, most=most).collect()}
    links = [(a, b) for a, b in combinations(range(90), 2) if abs(at[a] - at[b]) <= 2 and (bucket[a] == bucket[b] or b < 6)]
    assert [found.get(i, i) for i in range(90)] == classes(90, links)


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(4)
    pool = r.integers(0, 2**63, 400).astype(np.uint64)
    for _ in range(3):
        w1, w2 = r.integers(0, 9, 400), r.integers(0, 9, 400)
        w2 = np.where(r.random(400) < 0.7, w1, w2)
        bags = [(np.sort(pool[w > 0]), w[w > 0][np.argsort(pool[w > 0])]) for w in (w1, w2)]
        s = minhash.signatures(bags, 2048)
        assert np.isfinite(s).all()
        assert abs((s[0] == s[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.05
    one = minhash.signatures([(pool[:1], np.array([1])), (pool[:1], np.array([1])), (pool[:0], np.array([], int))], 144)
    assert (one[0] == one[1]).all() and np.isinf(one[2]).all()


def test_words_and_shingles_do_not_depend_on_place():
    a, b = Words(["x y, Z!", "the END é9"]), Words(["é9 q", "X y z"])
    assert a.hashes[:3].tolist() == b.hashes[2:].tolist() and a.hashes[-1] == b.hashes[0]
    assert len(shingles(a.hashes[:3])) == 1 and len(shingles(a.hashes[:0])) == 0


def near_corpus():
    rows, doc = [], 0
    for g in range(12):
        base = words(g, 80)
        for k in range(1 + g % 4):
            text = base[:]
            for j in range(k):
                text[(7 * j + g) % 80] = "edit"
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc, rows[3][1]), (doc + 1, rows[3][1]), (doc + 2, "x y"), (doc + 3, "X, y!"), (doc + 4, None), (doc + 5, "")]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_corpus()
    bags = [minhash.multiset(Words([t or ""]).hashes) for _, t in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if (rows[a][1] or "") == (rows[b][1] or "") or (bags[a][1].sum() and minhash.overlap(bags[a], bags[b]) >= 0.8)]
    want = classes(len(rows), links)
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == {rows[i][0]: rows[c][0] for i, c in enumerate(want)}
    assert sum(r.keep for r in found) == len(set(want))
    kept = minhash.first_of_each_group(frame(spark, rows))
    assert same_but(kept, frame(spark, rows)) and kept.count() == len(set(want))


def test_near_duplicates_of_a_corpus_against_brute_force(spark, sf_dir):
    """The classes of a whole table are those that all pairs with a common shingle give."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{larger if os.path.isdir(larger) else sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    texts = list(first)
    bags, having = [minhash.multiset(Words([t]).hashes) for t in texts], defaultdict(list)
    for k, (shingle, _) in enumerate(bags):
        for h in shingle.tolist():
            having[h].append(k)
    pairs = {p for v in having.values() for p in combinations(v, 2)}
    want = classes(len(texts), [p for p in pairs if minhash.overlap(bags[p[0]], bags[p[1]]) >= 0.8])
    of = {t: texts[c] for t, c in zip(texts, want)}
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: first[of[t]] for i, t in rows} and len(set(want)) < len(texts)


def test_near_duplicates_on_edges(edges, empty):
    found = minhash.near_duplicates(edges).collect()
    by = {r.doc_id: r.class_id for r in found if r.doc_id is not None}
    assert len(found) == len(edge_rows()) and by[10] == by[11] == by[12] == by[-5] == -5 and by[13] == by[14] == 13 and by[19] == 19
    kept = minhash.first_of_each_group(edges).collect()
    assert len([r for r in kept if r.doc_id == 12]) == 0 and len(kept) == len({(r.class_id, r.class_rows, r.keep) for r in found if r.keep})
    assert minhash.near_duplicates(empty).count() == 0 and minhash.first_of_each_group(empty).count() == 0


def test_kept_document_does_not_depend_on_partitions(spark):
    """Near copies under one doc_id, and rows that repeat doc_id and text with other columns."""
    base = words(61, 80)
    rows = [(5, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in range(8)] * 2 + [(None, " ".join(base)), (9, " ".join(base))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = []
        for n in (1, 4, 7, 13):
            docs = frame(spark, rows).repartition(n)
            found.append(([r._row for r in minhash.first_of_each_group(docs).collect()], {(r.class_id, bytes(r.digest)) for r in minhash.near_duplicates(docs).collect() if r.keep}))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = min(hashlib.md5(t.encode()).digest() for i, t in rows if i == 5)
    assert all(x == found[0] for x in found) and len(found[0][0]) == 1 and found[0][1] == {(5, least)}


def test_repeated_passage_inside_lines_is_found(spark):
    passage = " ".join(words(77, 55))
    rows = [(1, "Alpha beta. " + " ".join(words(5, 30)) + " " + passage + " " + " ".join(words(6, 20))), (2, " ".join(words(8, 33)) + "\n" + " ".join(words(9, 9)) + " " + passage + " ende"), (3, " ".join(words(10, 90))), (4, "ünï " + passage.upper())]
    found = substring_dedup.repeated_spans(frame(spark, rows)).collect()
    assert {r.doc_id for r in found} == {2, 4} and all(r.first_doc == 1 and r.n_words >= 30 for r in found)
    for r in found:
        assert dict(rows)[r.doc_id][r.start : r.stop].lower() in passage
    out = {r.doc_id: r.text for r in substring_dedup.without_repeats(frame(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and len(out[2]) < len(rows[1][1]) - 150


def ranked(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, int.from_bytes(substring_dedup.row_digest(*r)[8:], "big", signed=True)))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines_against_a_loop(spark, seed):
    """Every repeated line of any length goes, the earliest stays, and no word goes that stands in one place only."""
    r, pool = random.Random(seed), words(seed + 500, 4_000, (6, 10))
    shared = [" ".join(pool[k * 20 : k * 20 + 1 + k % 30]) for k in range(40)]
    rows, at = [], 1_500
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            if r.random() < 0.4:
                lines.append(r.choice([str.upper, str.title, lambda x: f" {x}!"])(r.choice(shared)))
            else:
                n = r.randint(1, 14)
                lines.append(", ".join(pool[at : at + n]))
                at += n
        rows.append((None if r.random() < 0.3 else r.randint(0, 20), "\n".join(lines)))
    docs = frame(spark, rows).repartition(5)
    spans = defaultdict(set)
    for x in substring_dedup.repeated_spans(docs, 1).collect():
        spans[x.digest] |= set(range(x.start, x.stop))
    seen, places = {}, defaultdict(set)
    for row in {x: None for x in ranked(rows)}:
        key, begin = substring_dedup.row_digest(*row).hex(), 0
        for line in row[1].split("\n"):
            n = line_dedup.normal(line)
            if n:
                inside = {begin + k for k, c in enumerate(line) if c.isalnum()}
                assert (inside <= spans[key]) == (n in seen), line
                seen[n] = row
            begin += len(line) + 1
        for m in re.finditer(r"\w+", row[1]):
            places[m[0].lower()].add((key, m.start()))
    for row in rows:
        key = substring_dedup.row_digest(*row).hex()
        assert all(len(places[m[0].lower()]) > 1 for m in re.finditer(r"\w+", row[1]) if m.start() in spans[key])
    left = substring_dedup.without_repeats(docs, 1)
    assert same_but(left, frame(spark, rows), "text")
    for x in left.collect():
        key = substring_dedup.row_digest(*rows[x._row]).hex()
        assert x.text == "".join(c for k, c in enumerate(rows[x._row][1]) if k not in spans[key])


def test_repeated_spans_on_edges(edges, empty):
    found = substring_dedup.repeated_spans(edges).collect()
    assert {r.doc_id for r in found} <= {10, 11, 12, 17, 20} and {10, 11, 12} <= {r.doc_id for r in found}
    assert same_but(substring_dedup.without_repeats(edges), edges, "text") and substring_dedup.without_repeats(edges).count() == len(edge_rows())
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_fuzzy_lines_keep_the_earliest(spark):
    line = " ".join(words(31, 60, (4, 9)))
    near = line[:-1] + ("x" if line[-1] != "x" else "y")
    rows = [(1, "first line of one\n" + line), (2, near + "\nsomething of its own here\n" + line.upper() + "!"), (3, "Yes.\nYes.\nfirst, line of one")]
    found = {r.doc_id: r.removed for r in line_dedup.repeated_lines(frame(spark, rows)).collect()}
    assert found[1] == [] and found[2] == [0, 2] and found[3] == [1, 2]
    out = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_repeated_lines(frame(spark, rows)).collect()}
    assert out[3] == ("Yes.", 4) and out[1] == (rows[0][1], len(rows[0][1]))


def test_exact_repeats_of_lines_all_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = {r.doc_id: set(r.removed) for r in line_dedup.repeated_lines(docs).collect()}
    seen = set()
    for i, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        for k, n in enumerate(map(line_dedup.normal, text.split("\n"))):
            assert k in removed[i] if n and n in seen else n or k not in removed[i]
            seen.add(n)


def test_fuzzy_lines_find_brute_force_pairs(spark, sf_dir):
    """Of all pairs with the stated edit similarity, the later line goes; no line goes without such a pair or an equal line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = [(r.doc_id, k, n) for r in sorted(docs.collect()) for k, x in enumerate((r.text or "").split("\n")) if (n := line_dedup.normal(x))]
    first = {n: (i, k) for i, k, n in reversed(lines)}
    distinct = sorted(first, key=len)
    counts = np.array([[x.count(c) for c in "abcdefghijklmnopqrstuvwxyz "] for x in distinct])
    sizes, pairs = np.array([len(x) for x in distinct]), []
    for i, x in enumerate(distinct):
        stop = np.searchsorted(sizes, sizes[i] / line_dedup.SIMILARITY + 1e-9, "right")
        limits = ((1 - line_dedup.SIMILARITY) * sizes[i + 1 : stop] + 1e-9).astype(int)
        apart = np.abs(counts[i + 1 : stop] - counts[i]).sum(axis=1)
        pairs += [(x, distinct[i + 1 + k]) for k in np.flatnonzero(apart <= 2 * limits) if line_dedup.within(x, distinct[i + 1 + k], int(limits[k]))]
    removed = {(r.doc_id, k) for r in line_dedup.repeated_lines(docs).collect() for k in r.removed}
    assert len(pairs) >= 5 and np.mean([max(first[a], first[b]) in removed for a, b in pairs]) >= 0.95
    near = {max(first[a], first[b]) for a, b in pairs} | {(i, k) for i, k, n in lines if first[n] != (i, k)}
    assert removed <= near | {first[x] for p in pairs for x in p}


def test_fuzzy_lines_find_small_edits(spark):
    """Lines of three to forty words with one letter changed or one word of twelve or more replaced."""
    r, rows = random.Random(5), []
    for seed in range(400):
        parts = words(seed + 1000, 3 + seed % 38, (4, 9))
        line, k = " ".join(parts), r.randrange(len(parts))
        other = "q" + parts[k][1:] if seed % 2 or len(parts) < 12 else "changed"
        rows += [(2 * seed, line), (2 * seed + 1, " ".join(parts[:k] + [other] + parts[k + 1 :]))]
    found = {x.doc_id: x.removed for x in line_dedup.repeated_lines(frame(spark, rows)).collect()}
    assert all(found[2 * i] == [] for i in range(400))
    assert sum(found[2 * i + 1] == [0] for i in range(400)) >= 392


def test_short_lines_go_in_query_and_stage(spark, tmp_path):
    """Lines of one or two words, and long ones that are one word for want of spaces, are compared too."""
    long = "这是一行没有空格的很长的中文文字用来检查去重"
    rows = [(1, "Yes.\nand ornd\n...\n" + long), (2, "yes\nAnd, ornd!\n...\nown line of two"), (3, long + "\n" + long.replace("检查", "检看") + "\nno\nNO")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_lines, r.removed) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: (3, []), 2: (3, [0, 1]), 3: (4, [0, 1, 3])}
    left = {r.doc_id: r.text for r in lines_once(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "...\nown line of two", 3: "no"}


def test_lines_on_edges(edges, empty):
    found = line_dedup.repeated_lines(edges).collect()
    assert len(found) == len(edge_rows())
    by = {r.doc_id: r.removed for r in found}
    assert by[21] == [1] and by[11] == [0, 1] and by[14] == []
    left = line_dedup.without_repeated_lines(edges)
    assert same_but(left, edges, "text", "n_chars") and left.count() == len(edge_rows())
    assert line_dedup.repeated_lines(empty).count() == 0
