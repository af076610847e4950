"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has ordered grades 0..K-1. One weight vector serves all thresholds: P(grade > k) =
sigmoid(w.x - theta_k) with theta increasing, and the result is the expected grade. Features are
hashed words and word beginnings (log of their count) chosen by the z-value of their log odds, and
their rate.

Where labels only say toxic or not, grades 1..GRADES-1 are given to the toxic ones by how dense toxic
words are in them; the words for one half of the labelled rows are chosen on the other half, so a grade isn't made of the
features that are fitted to it. The fit uses at most MAX_LABELLED labelled rows, those with the
smallest hashes of their ids; in how many of them each feature stands is counted by Spark, and only the counts of
chosen features come to the driver. Scoring reads every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import vectext as V

U64 = np.uint64
BITS = 18
MAX_LABELLED = 20_000
MAX_FEATURES = 512
MIN_Z = 4.0
GRADES = 4


#: Words count whole and by their first so many bytes, so that inflected and compound forms share evidence.
STEMS = (4, 5)
#: A chosen feature must be this much likelier (log odds) in toxic documents.
MIN_ODDS = 2.0


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, their documents, words by document, and a key that near copies mostly share."""
    n = len(off) - 1
    data = V.LOWER[data]
    start, end, woff = V.words(data, off, V.ALNUM)
    count = np.diff(woff)
    key = np.zeros(n, U64)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), count, key
    doc = np.repeat(np.arange(n), count)
    h = V.word_hashes(data, start, end)
    with np.errstate(over="ignore"):
        pair = V.mix(h * U64(V.BASE) + np.append(h[1:], U64(0)))
    key[count > 0] = np.minimum.reduceat(pair, woff[:-1][count > 0])
    found, docs = [h], [doc]
    for size in STEMS:
        long = np.flatnonzero(end - start > size)
        with np.errstate(over="ignore"):
            found.append(V.mix(V.word_hashes(data, start[long], start[long] + size) + U64(size)))
        docs.append(doc[long])
    return (np.concatenate(found) >> U64(64 - BITS)).astype(np.int32), np.concatenate(docs), count, key


@dataclass
class OrdinalModel:
    """slots: number of each hashed feature, or -1. weights: one for each feature and one for the rate."""

    slots: np.ndarray
    weights: np.ndarray
    thetas: np.ndarray
    positive: np.ndarray

    def matrix(self, feature: np.ndarray, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Margin w.x of each document, added up over its chosen words only."""
        slot = self.slots[feature]
        at = slot >= 0
        n, k = len(words), max(1, len(self.positive))
        key, count = np.unique(doc[at].astype(np.int64) * k + slot[at], return_counts=True)
        d, f = key // k, key % k
        out = np.bincount(d, np.log1p(count) * self.weights[f], minlength=n)
        hits = np.bincount(d, count * self.positive[f], minlength=n)
        return out + self.weights[-1] * np.log1p(100 * hits / np.maximum(words, 1))

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thetas[None, :], -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by gradient steps (Adam) on the cumulative-link likelihood."""
    n, k = x.shape
    share = np.clip([(y > g).mean() for g in range(grades - 1)], 1e-4, 1 - 1e-4)
    theta0 = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta0), 0.05))
    p = np.concatenate([np.zeros(k), theta0[:1], gaps])
    m = v = np.zeros_like(p)
    for t in range(1, steps + 1):
        w, theta = p[:k], np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))
        margin = x @ w
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        hi, lo = sig(edge[y + 1] - margin), sig(edge[y] - margin)
        like = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g_margin = (dhi - dlo) / like
        g_theta = np.bincount(y, -dhi / like, minlength=grades)[: grades - 1] + np.bincount(y, dlo / like, minlength=grades)[1:]
        g0, tail = g_theta.sum(), np.cumsum(g_theta[::-1])[::-1][1:]
        g = np.concatenate([x.T @ g_margin / n + ridge * w, [g0 / n], tail * np.exp(p[k + 1 :]) / n])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:k], np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))


def choose(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, most: int) -> np.ndarray:
    """Features by the z-value of their log odds, from the numbers of toxic and other documents that hold each."""
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    z = odds / np.sqrt(1 / (c1 + 0.5) + 1 / (n1 - c1 + 0.5) + 1 / (c0 + 0.5) + 1 / (n0 - c0 + 0.5))
    z[odds < MIN_ODDS] = 0
    chosen = np.argsort(-z, kind="stable")[:most]
    return chosen[z[chosen] >= (MIN_Z if n1 >= 100 else 2.0)]


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = V.flat(batch.column(0))
        feats, counts, words, keys = [], [], [], []
        for i, j in V.chunks(off):
            f, d, w, own = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            keys += own.view(np.int64).tolist()
            key, n = np.unique(d.astype(np.int64) << BITS | f, return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(j - i + 1))
            f = (key & ((1 << BITS) - 1)).astype(np.int32)
            feats += [f[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            counts += [n[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            words += w.tolist()
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(feats, pa.binary()), pa.array(counts, pa.binary()), pa.array(words, pa.int64()), pa.array(keys, pa.int64())], names=["grade", "f", "c", "words", "key"])


def _in_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's documents (kind, f) of each kind hold each feature; feature -1: how many there are."""
    for batch in batches:
        kind = batch.column(0).to_numpy()
        data, off = V.flat(batch.column(1))
        f = data.view(np.int32) if len(data) else np.zeros(0, np.int32)
        k = np.repeat(kind, np.diff(off) // 4).astype(np.int64)
        both = np.concatenate([k << 32 | f, kind.astype(np.int64) << 32 | ((1 << 32) - 1)])
        key, n = np.unique(both, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & ((1 << 32) - 1)).astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int64))], names=["kind", "feature", "n"])


def _only(slots: np.ndarray):
    """Of each document, the slots and counts of chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for f, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = slots[np.frombuffer(f, np.int32)]
                found.append(own[own >= 0].astype(np.int32).tobytes())
                counts.append(np.frombuffer(c, np.int32)[own >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(counts, pa.binary()), batch.column(3), batch.column(4)], names=["grade", "f", "c", "words", "half"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", graded: bool = False, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fits on the labelled rows with the smallest id hashes, at most max_labelled of them.

    Null labels and ids are left out; of repeated labels of an id the highest counts; repeated ids of docs each count. Very
    long texts are read whole. Without labels of both kinds, the model says grade 0 for all (or 1 for all, if all are toxic).
    """
    sample = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(F.max(F.col(label_column).cast("int")).alias("grade")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    # Bounded by max_labelled rows of 12 bytes.
    known = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text")).join(F.broadcast(sample), F.col(id_column) == F.col("label_id")).select("text", "grade")
    rows, path = store.write(known.mapInArrow(_collect, "grade int, f binary, c binary, words long, key long"), "labelled")
    half = F.pmod(F.xxhash64("key"), F.lit(2)).cast("int")
    kind = (F.col("grade") > 0).cast("int") * 2 + half
    # Near copies (rows with one key and label) count once in the choice of features: the first by their features.
    once = rows.groupBy("key", kind.alias("kind")).agg(F.min_by("f", F.xxhash64("f", "c")).alias("f")).select("kind", "f")
    counts = np.zeros((4, 1 << BITS))
    total = np.zeros(4, np.int64)
    got = once.mapInArrow(_in_documents, "kind int, feature int, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")).toArrow()  # at most 4 x 2**BITS rows
    which, feature, n = (got[c].to_numpy() for c in ("kind", "feature", "n"))
    total[which[feature < 0]] = n[feature < 0]
    counts[which[feature >= 0], feature[feature >= 0]] = n[feature >= 0]
    size = 1 << BITS
    toxic, clean = total[2:].sum(), total[:2].sum()
    if not toxic or not clean:
        store.drop(docs.sparkSession, path)
        return OrdinalModel(np.full(size, -1, np.int32), np.zeros(1), np.full(1, 40.0 if not toxic else -40.0), np.zeros(0))
    chosen = choose(counts[2] + counts[3], counts[0] + counts[1], toxic, clean, max_features)
    # Words for the grades of one half come from the other.
    cross = [choose(counts[3 - h], counts[1 - h], total[3 - h], total[1 - h], max_features) if total[3 - h] and total[1 - h] else chosen for h in (0, 1)]
    every = np.unique(np.concatenate([chosen, *cross]))
    slots = np.full(size, -1, np.int32)
    slots[every] = np.arange(len(every))
    part = rows.select("grade", "f", "c", "words", half.alias("half")).mapInArrow(_only(slots), "grade int, f binary, c binary, words long, half int").toArrow()
    store.drop(docs.sparkSession, path)
    found = [np.frombuffer(x, np.int32) for x in part["f"].to_pylist()]
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
    slot, count = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (found, [np.frombuffer(x, np.int32) for x in part["c"].to_pylist()]))
    grade, words, side = part["grade"].to_numpy().astype(np.int64), np.maximum(part["words"].to_numpy(), 1), part["half"].to_numpy()
    return train(doc, every[slot], count, words, grade, side, chosen, cross, graded)


def _rate(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, words: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Chosen features to a word, by document."""
    at = np.isin(feature, chosen)
    return np.bincount(doc[at], count[at], minlength=len(words)) / words


def train(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, words: np.ndarray, grade: np.ndarray, side: np.ndarray, chosen: np.ndarray, cross: list[np.ndarray], graded: bool) -> OrdinalModel:
    """From how often (count) each document (doc) holds each feature, and the documents' words, grades and halves."""
    slots = np.full(1 << BITS, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    x = np.zeros((len(words), len(chosen) + 1), np.float32)
    at = slots[feature] >= 0
    x[doc[at], slots[feature[at]]] = np.log1p(count[at])
    x[:, -1] = np.log1p(100 * _rate(doc, feature, count, words, chosen))
    y = grade
    if not graded:
        rate = np.where(side == 0, _rate(doc, feature, count, words, cross[0]), _rate(doc, feature, count, words, cross[1]))
        bad = grade > 0
        cuts = np.quantile(rate[bad], [g / (GRADES - 1) for g in range(1, GRADES - 1)])
        y = np.where(bad, 1 + np.searchsorted(cuts, rate, "right"), 0)
    weights, thetas = fit_ordinal(x, y, int(y.max()) + 1)
    return OrdinalModel(slots, weights, thetas, np.ones(len(chosen)))


def _score_batch(model: OrdinalModel, column: pa.Array) -> np.ndarray:
    data, off = V.flat(column)
    out = [np.zeros((0, len(model.thetas)))]
    for i, j in V.chunks(off):
        f, d, w, _ = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
        out.append(model.above(model.matrix(f, d, w)))
    return np.concatenate(out)


def score(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id_column, expected_severity, severity (most likely grade), p_toxic, toxic (p_toxic >= 0.5).

    Null and empty texts have no features and get the model's base rate; repeated rows are treated alike; an empty
    table gives an empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = _score_batch(model, batch.column(1))
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], names=[id_column, "expected_severity", "severity", "p_toxic", "toxic"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, expected_severity double, severity int, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, text_column: str = "text") -> DataFrame:
    """The rows that aren't toxic, all columns as they were."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_batch(model, batch.column(at))[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
