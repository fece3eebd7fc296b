import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, shard int, start long, bands string, _row int, _removed string, _times int, own string, removed int, parts int, c0 double, c1 array<int>"


def words(seed, n, sizes=(2, 9)):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(*sizes))) for _ in range(n)]


def edge_rows():
    base = " ".join(words(1, 60)) + ".\n" + " ".join(words(2, 40)) + "."
    near = base.replace(" ".join(words(1, 60)[20:22]), "changed here")
    return [
        (10, base), (11, base), (12, near), (12, near), (None, "a row without any number but with some words"), (None, None),
        (13, None), (14, ""), (15, "  \n\t \x1c\x85"), (16, "a" * 60_000), (17, "word " * 8_000), (18, "Ünïcödé 🙂 中文字 and <|endoftext|> inside"),
        (19, "one two"), (20, "'ll 12 it's ²¼ İI " * 30), (21, "same line here again\nsame line here again\nanother one of them"), (-5, base + " tail"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", None if t is None else len(t), 7, "x", 3, 1, "b", k, f"r{k}", 2, None, k + 1, 5, k / 2, [k]) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, edge_rows()).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).select("*")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path


def same_but(found, rows, *changed):
    """Whether all columns of found but the changed ones, found by _row, are those of frame(rows), types included."""
    was = {r._row: r for r in rows.collect()}
    names = [c for c in rows.columns if c not in changed]
    return found.schema == rows.schema and all(getattr(r, c) == getattr(was[r._row], c) for r in found.collect() for c in names)
