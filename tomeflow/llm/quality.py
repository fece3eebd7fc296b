"""Quality classification by co-training a text view and a metadata view.

Each view is a logistic regression over its own bins. The text view has a bin for each hashed word and for
each level of some ratios (capitals, marks, repetition ...) and fits the words that tell the classes apart
beyond chance; the metadata view has bins for the other columns. Fitting takes about `labelled` labelled
texts at most, each text once. In each round both views score all unlabelled documents, and about `pseudo`
of the texts that a view is confident of become weighted labels for the other. Both samples are chosen by
the hash of a text's digest alone, so the model doesn't depend on how rows are partitioned. Scores of both
views are calibrated on labelled texts held out from fitting and added as log-odds; all documents are scored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shelf, arrow_map, batch_of, renamed, stored, text_digest, texts_of

#: About the most texts that a view is fitted to: labelled ones, and pseudo-labels of each round.
LABELLED, PSEUDO = 12_000, 4_000
WORD_BINS, RATIO_BINS, META_BINS = 1 << 18, 1 << 10, 1 << 12
TEXT_BINS = WORD_BINS + RATIO_BINS

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))
_UPPER, _LOWER, _DIGIT, _SPACE = (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \n\t\r")
_STOPS = b".,;:'\"-?()"
_EDGES = np.array([1e-9, 0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


def text_bins(text: str) -> np.ndarray:
    """The bins of a text: its distinct words, and a level for each ratio. An empty text has ratio bins only."""
    raw = text.encode()
    n = max(1, len(raw))
    words = raw.translate(_LETTERS).split()
    distinct = set(words)
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    tokens = raw.split()
    marks = 1 - len(raw.translate(None, _UPPER + _LOWER + _DIGIT + _SPACE + _STOPS + bytes(range(128, 256)))) / n
    ratios = [
        share(_UPPER), share(_DIGIT), share(b"!"), share(b"|"), share(b"#$%&*~^_=+"), share(b"\n"), 1 - marks,
        len(distinct) / max(1, len(words)), len(set(tokens)) / max(1, len(tokens)),
        sum(a == b for a, b in zip(tokens, tokens[1:])) / max(1, len(tokens)),
        min(1.0, len(tokens) / n * 3),
    ]
    levels = np.searchsorted(_EDGES, ratios, "right") + 32 * np.arange(len(ratios)) + WORD_BINS
    hashed = np.fromiter((zlib.crc32(w) & (WORD_BINS - 1) for w in distinct), np.int64, len(distinct))
    return np.unique(np.concatenate([hashed, levels])).astype("<i4")


def meta_bins(values: list[tuple[str, object]]) -> np.ndarray:
    """The bins of a row's metadata: each value, numbers by their order of magnitude, and neighbouring pairs."""
    said = []
    for name, v in values:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = "none" if v != v else f"{int(math.copysign(1, v) * math.log2(1 + min(abs(v), 1e300)) * 2)}"
        said.append(f"{name}={v}")
    said += [f"{a}&{b}" for a, b in zip(said, said[1:])]
    return np.unique(np.array([zlib.crc32(x.encode()) & (META_BINS - 1) for x in said], "<i4"))


def _distinguishing(flat: np.ndarray, of: np.ndarray, bad: np.ndarray, bins: int) -> np.ndarray:
    """The words (bins below `bins`) whose share among all distinct words differs most surely by class."""
    word = flat < bins
    x1 = np.bincount(flat[word & bad[of]], minlength=bins).astype(float)
    x0 = np.bincount(flat[word & ~bad[of]], minlength=bins).astype(float)
    n1, n0 = max(1.0, x1.sum()), max(1.0, x0.sum())
    p = (x0 + x1) / (n0 + n1)
    ratio = sum(2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(n * p, 1e-12)), 0) for x, n in ((x0, n0), (x1, n1)))
    return np.flatnonzero(ratio > 12)


@dataclass
class View:
    """A weight for each bin, an intercept, and the calibration of their sum."""

    bins: int
    #: So many of the first bins are words.
    words: int = 0
    weights: np.ndarray = field(init=False)
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self.weights = np.zeros(self.bins, np.float32)

    def fit(self, packed: list[bytes], bad: np.ndarray, weight: np.ndarray, steps: int = 300, decay: float = 2e-3) -> None:
        """Logistic regression by gradient steps of own size for each weight (Adam), decayed towards 0."""
        n = np.array([len(x) // 4 for x in packed], np.int64)
        flat, of = np.frombuffer(b"".join(packed), "<i4"), np.repeat(np.arange(len(packed)), n)
        chosen = np.concatenate([_distinguishing(flat, of, bad, self.words), np.unique(flat[flat >= self.words])]).astype(np.int64)
        place = np.full(self.bins, -1, np.int64)
        place[chosen] = np.arange(len(chosen))
        keep = place[flat] >= 0
        column, row = place[flat[keep]], of[keep]
        w, first, second = np.zeros((3, len(chosen) + 1))
        share = weight / weight.sum()
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(packed)) + w[-1], -35, 35)))
            error = share * (p - bad)
            gradient = np.append(np.bincount(column, error[row], len(chosen)) + decay / 10 * w[:-1], error.sum())
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights = np.zeros(self.bins, np.float32)
        self.weights[chosen], self.intercept = w[:-1], float(w[-1])

    def scores(self, packed: list[bytes]) -> np.ndarray:
        """The log-odds of each row's bins, uncalibrated."""
        flat = np.frombuffer(b"".join(packed), "<i4")
        of = np.repeat(np.arange(len(packed)), [len(x) // 4 for x in packed])
        return np.clip(np.bincount(of, self.weights[flat], len(packed)) + self.intercept, -30, 30)

    def logits(self, scores: np.ndarray) -> np.ndarray:
        return self.slope * scores + self.offset

    def calibrate(self, histogram: dict[float, tuple[float, float]]) -> None:
        """Fits slope and offset to (good, bad) counts by score, held near 1 and 0 where rows are few."""
        self.slope, self.offset = 1.0, 0.0
        if not histogram:
            return
        s = np.array(list(histogram), float)
        good, bad = (np.array([histogram[x][k] for x in histogram], float) for k in (0, 1))

        def loss(at: np.ndarray) -> float:
            z = at[0] * s + at[1]
            return float((good * np.logaddexp(0, z) + bad * np.logaddexp(0, -z)).sum() + 2 * (at[0] - 1) ** 2 + at[1] ** 2 / 2)

        at = np.array([1.0, 0.0])
        for _ in range(100):  # Newton's steps, halved until they lower the loss
            p = 1 / (1 + np.exp(-np.clip(at[0] * s + at[1], -35, 35)))
            w, error = (good + bad) * p * (1 - p), (good + bad) * p - bad
            gradient = np.array([(error * s).sum() + 4 * (at[0] - 1), error.sum() + at[1]])
            step = np.linalg.solve([[(w * s * s).sum() + 4, (w * s).sum()], [(w * s).sum(), w.sum() + 1]], gradient)
            while abs(step).max() > 1e-7 and loss(at - step) > loss(at):
                step /= 2
            at = at - step
            if abs(step).max() < 1e-6:
                break
        self.slope, self.offset = max(0.0, at[0]), at[1]


FEATURES = "doc_id long, digest binary, text_bins binary, meta_bins binary"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, digest (md5 of the text) and the bins of both views of every row of docs.

    Metadata are all columns but doc_id and text that hold strings or numbers; null is a value of its own.
    """
    kinds = ("string", "int", "bigint", "smallint", "tinyint", "float", "double")
    meta = [c for c, kind in docs.dtypes if kind in kinds and c not in ("doc_id", "text")]
    chosen = docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in meta)).toDF("doc_id", "text", *(f"m{i}" for i in range(len(meta))))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch)
        columns = [batch.column(2 + i).to_pylist() for i in range(len(meta))]
        values = zip(*columns, strict=True) if columns else ((),) * len(texts)
        digests = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts]
        yield batch_of({"doc_id": batch.column(0), "digest": digests, "text_bins": [text_bins(t).tobytes() for t in texts], "meta_bins": [meta_bins(list(zip(meta, v))).tobytes() for v in values]}, {"digest": pa.binary(), "text_bins": pa.binary(), "meta_bins": pa.binary()})

    return arrow_map(chosen, run, FEATURES)


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def probabilities(self, text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(by text, by metadata, by both) that a document is to be rejected."""
        a, b = self.text.logits(self.text.scores(text)), self.meta.logits(self.meta.scores(meta))
        return tuple(1 / (1 + np.exp(-np.clip(x, -35, 35))) for x in (a, b, a + b - self.prior))


def _sampled(rows: DataFrame, most: int, total: int) -> DataFrame:
    """About `most` of the `total` texts of rows, chosen by their digest alone."""
    part = min(1_000_000, int(1_000_000 * most / max(1, total)))
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "digest"), F.lit(1_000_000)) < part)


def _confident(rows: DataFrame, views: list[View], confident: float) -> DataFrame:
    """Of all rows, those that a view is sure of: view, bad, digest and the bins of the other view."""
    limit = math.log(confident / (1 - confident))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packed = [batch.column(1 + k).to_pylist() for k in range(2)]
        for k in range(2):
            logits = views[k].logits(views[k].scores(packed[k]))
            sure = np.flatnonzero(abs(logits) >= limit)
            at = pa.array(sure)
            yield batch_of({"view": np.full(len(sure), k, np.int32), "bad": logits[sure] > 0, "digest": batch.column(0).take(at), "bins": batch.column(2 - k).take(at)}, {})

    return arrow_map(rows.select("digest", "text_bins", "meta_bins"), run, "view int, bad boolean, digest binary, bins binary")


def co_train(rows: DataFrame, rounds: int = 2, confident: float = 0.98, weight: float = 0.25, held_out: float = 0.25, labelled: int = LABELLED, pseudo: int = PSEUDO) -> Model | None:
    """Fits both views to rows (digest, text_bins, meta_bins and bad; bad is null where unlabelled).

    None without labels of both kinds. Of rows with equal text one counts, with the least metadata bins, as bad
    if any is; so does one of equal texts that a view is confident of.
    """
    texts = rows.where("bad is not null").groupBy("digest").agg(F.max("bad").alias("bad"), F.min("text_bins").alias("text_bins"), F.min("meta_bins").alias("meta_bins"))
    counts = {r["bad"]: r["count"] for r in rows.where("bad is not null").select("digest", "bad").groupBy("digest").agg(F.max("bad").alias("bad")).groupBy("bad").count().collect()}
    if not counts.get(True) or not counts.get(False):
        return None
    known = _sampled(texts, labelled, sum(counts.values())).toPandas()
    known = known.iloc[np.argsort(known["digest"].map(bytes).to_numpy(), kind="stable")]
    held = (np.arange(len(known)) % 100) < 100 * held_out
    bad = known["bad"].to_numpy(bool)
    bins = [known[c].map(bytes).tolist() for c in ("text_bins", "meta_bins")]
    pick = lambda values, mask: [v for v, m in zip(values, mask) if m]
    extra: list[tuple[list[bytes], np.ndarray]] = [([], np.zeros(0, bool))] * 2
    for k in range(rounds + 1):
        views = [View(TEXT_BINS, WORD_BINS), View(META_BINS)]
        for v, own, (more, said) in zip(views, bins, extra, strict=True):
            v.fit(pick(own, ~held) + more, np.concatenate([bad[~held], said]), np.concatenate([np.ones((~held).sum()), np.full(len(more), weight)]))
            scores, histogram = np.round(v.scores(pick(own, held)) * 4) / 4, {}
            for s, b in zip(scores.tolist(), bad[held].tolist()):
                good_bad = histogram.get(s, (0, 0))
                histogram[s] = (good_bad[0] + (not b), good_bad[1] + b)
            v.calibrate(histogram)
        if k < rounds:
            extra = _exchanged(_confident(rows.where("bad is null"), views, confident), pseudo)
    return Model(*views, prior=math.log(counts[True] / counts[False]))


def _exchanged(sure: DataFrame, pseudo: int) -> list[tuple[list[bytes], np.ndarray]]:
    """For each view, bins and labels of about `pseudo` texts that the other view is sure of."""
    sizes = {r["view"]: r["count"] for r in sure.select("view", "digest").distinct().groupBy("view").count().collect()}
    extra = []
    for other in (1, 0):
        some = _sampled(sure.where(F.col("view") == other), pseudo, sizes.get(other, 0))
        some = some.groupBy("digest").agg(F.min(F.struct("bins", "bad")).alias("x")).select("digest", "x.bins", "x.bad").toPandas()
        some = some.iloc[np.argsort(some["digest"].map(bytes).to_numpy(), kind="stable")]
        extra.append((some["bins"].map(bytes).tolist(), some["bad"].to_numpy(bool)))
    return extra


SCORES = "doc_id long, digest binary, p_text double, p_meta double, p_reject double, keep boolean"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings: float) -> DataFrame:
    """doc_id, digest (md5 of the text), p_text, p_meta, p_reject and keep (p_reject below threshold) of every row of docs.

    labels: doc_id, quality, toxic. A document is to be rejected if a label calls it toxic (1) or of low
    quality (0); contradicting labels count as the worse one, null fields say nothing. Without labels of
    both kinds all is kept, with p_reject 0. Null texts are judged as empty ones. Repeated rows are judged
    alike, a null doc_id is judged but can't be labelled. Texts of any length are judged whole. Other columns,
    whatever their names, are metadata; an empty table gives no rows. settings: see co_train.
    """
    by_doc = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), True).when((F.col("toxic") == 0) | (F.col("quality") == 1), False)).alias("bad"))
    with Shelf(docs.sparkSession) as shelf:
        rows = shelf.put(features(docs).join(by_doc.hint("merge"), "doc_id", "left"), "quality", compression="zstd")
        model = co_train(rows, **settings)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = batch.num_rows
            p = model.probabilities(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if model else (np.zeros(n),) * 3
            yield batch_of({"doc_id": batch.column(0), "digest": batch.column(1), "p_text": p[0], "p_meta": p[1], "p_reject": p[2], "keep": p[2] < threshold}, {})

        return stored(arrow_map(rows.select("doc_id", "digest", "text_bins", "meta_bins"), run, SCORES), "scores", compression="zstd")


def kept_documents(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs as they are, whatever their names.

    Rows that repeat doc_id and text go together, if any is rejected. Null and empty texts and null doc_ids are
    judged as in classify(); an empty table gives no rows.
    """
    bad = classify(docs, labels, **settings).where("not keep").select("doc_id", "digest").distinct()
    plain, back = renamed(docs)
    doc, text = (f"c{docs.columns.index(x)}" for x in ("doc_id", "text"))
    return back(plain.withColumn("own", text_digest(text)).join(bad, F.col(doc).eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")), "left_anti"))
