"""Quality classifier by co-training of two views.

View one sees the text (kinds of characters, words, repetition), view two the
page's metadata alone (language, source, stated length). Both start from the
labelled rows; each round, each view hands the rows of an unlabelled pool that
it is sure of to the other as labels. How sure is sure enough is read off one
part of the labels that is held out; a second part calibrates the views, and a
third fits the logistic combination of the calibrated views that scores every
document.

Fitting takes bounded samples to the driver (`sample` labelled rows, `pool`
unlabelled ones); scoring runs over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import OWN, released, small_batches, stage, tidy, without

#: Kinds of bytes: lower case, upper case, digits, blanks, line ends, single marks, other ASCII, beyond ASCII.
_MARKS = b".,;:!?'\"-()|#$%&*"
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]], _KIND[128:] = 0, 1, 2, 3, 4, 5
for _i, _c in enumerate(_MARKS):
    _KIND[_c] = 7 + _i
KINDS = 7 + len(_MARKS)
#: Slots for hashed sources and languages, and half octaves of length.
SOURCES, LANGS, SIZES = 64, 32, 44
_ADDED = ("p_text", "p_meta", "score", "keep")


def text_view(column: pa.Array) -> np.ndarray:
    """Features of whole texts: shares of kinds of bytes, word lengths, repetition, line lengths."""
    data, offs = tv.buffers(column)
    n = len(column)
    counts = np.zeros((n, KINDS))
    for lo in range(0, len(data), tv.CHUNK):
        part = data[lo : lo + tv.CHUNK]
        a, b = np.searchsorted(offs, lo, "right") - 1, np.searchsorted(offs, lo + len(part), "left")
        row = np.repeat(np.arange(a, b), np.diff(np.clip(offs[a : b + 1], lo, lo + len(part))))
        counts[a:b] += np.bincount((row - a) * KINDS + _KIND[part], minlength=(b - a) * KINDS).reshape(-1, KINDS)
    w = tv.words_of(data, offs)
    words = np.maximum(w.counts, 1)
    size = np.maximum(np.diff(offs), 1)
    row = np.repeat(np.arange(n), w.counts)
    length = w.end - w.start
    by = lambda x: np.bincount(row, weights=x, minlength=n) / words
    same = np.zeros(len(w.hash))
    if len(w.hash) > 1:
        same[1:] = w.hash[1:] == w.hash[:-1]
    ends = _KIND[data[w.end - 1]] if len(w.end) else np.zeros(0, np.int64)
    uniq, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        h = np.sort(w.hash[w.first[i] : w.first[i + 1]])
        if len(h):
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            uniq[i], top[i] = len(edge) / len(h), np.diff(np.append(edge, len(h))).max() / len(h)
    share = counts / size[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    return np.column_stack([share, np.sqrt(share[:, 7:]), counts[:, 1] / letters, by(length), by(length <= 2), by(length > 12), by(ends >= 7), by(ends >= 11), by(same), uniq, top, np.log1p(words) * uniq, np.log1p(counts[:, 4] / words)])


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Features of a page's metadata: hashed language and source, and the stated length, on a line and by half octaves."""
    n = len(lang)
    out = np.zeros((n, LANGS + SOURCES + SIZES + 2))
    size = np.log2(1 + np.array([0 if c is None else max(0, c) for c in n_chars], float))
    for i, (a, b) in enumerate(zip(lang, source, strict=True)):
        out[i, zlib.crc32((a or "").encode()) % LANGS] = 1
        out[i, LANGS + zlib.crc32((b or "").encode()) % SOURCES] = 1
    out[np.arange(n), LANGS + SOURCES + np.minimum(SIZES - 1, (2 * size).astype(int))] = 1
    out[:, -2], out[:, -1] = size, size**2 / 10
    return out


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float)
        scale = np.where(scale > 1e-9, scale, 1)
        z = np.ones((len(x), x.shape[1] + 1))
        np.divide(np.subtract(x, mean, out=z[:, :-1]), scale, out=z[:, :-1])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (y - p) - penalty * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), g)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class CoTrained:
    """Two views, their calibrations and their combination; exchanged counts pseudo-labels by round."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    exchanged: list[tuple[int, int]]

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by text, by metadata, and by both."""
        a = self.text_scale.margin(self.text.margin(x_text)[:, None])
        b = self.meta_scale.margin(self.meta.margin(x_meta)[:, None])
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both.margin(np.column_stack([a, b])))


def _sure(margin: np.ndarray, y: np.ndarray, purity: tuple[float, float]) -> tuple[float, float]:
    """Margins above which held-out rows are good, and below which they are bad, with at least the purity of either class."""
    found = []
    for sign, least in zip((1, -1), purity, strict=True):
        order = np.argsort(-sign * margin, kind="stable")
        right = np.cumsum((y[order] == (sign > 0)).astype(float))
        n = np.arange(1, len(y) + 1)
        # a lower bound: one more wrong row than seen
        good = np.flatnonzero((right / (n + 1) >= least) & (n >= 20))
        found.append(margin[order[good[-1]]] if len(good) else sign * np.inf)
    return found[0], found[1]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = 4, purity: tuple[float, float] = (0.9, 0.97), grow: float = 0.25) -> CoTrained:
    """Fit both views on labels y (0 or 1) and a pool without labels.

    Of every eight labelled rows one is held out for thresholds, one for
    calibration and one for the combination. A class's pseudo-labels must be
    wrong half as often as its share alone would make them, within the bounds
    `purity`: views of different strength both find rows that they are sure of.
    Rows on which both views are sure, and differ, are not exchanged.
    """
    part = np.arange(len(y)) % 8
    own, sure, scale, mix = part % 2 == 1, part == 2, part == 4, part == 6
    own |= part == 0
    given = {"text": (xt[own], y[own].astype(float)), "meta": (xm[own], y[own].astype(float))}
    free = {"text": np.ones(len(pool_t), bool), "meta": np.ones(len(pool_t), bool)}
    x, pool, exchanged = {"text": xt, "meta": xm}, {"text": pool_t, "meta": pool_m}, []
    shares = (y.mean(), 1 - y.mean())
    wanted = tuple(float(np.clip(1 - (1 - s) / 2, *purity)) for s in shares)
    for turn in range(rounds + 1):
        model = {v: Logistic.fit(*given[v]) for v in given}
        if turn == rounds or not len(pool_t):
            break
        cuts = {v: _sure(model[v].margin(x[v][sure]), y[sure], wanted) for v in model}
        margins = {v: model[v].margin(pool[v]) for v in model}
        moved = []
        for mine, other in (("text", "meta"), ("meta", "text")):
            # as many of each class as its share among the labels, surest first; what the other view is sure is wrong stays
            take = []
            for sign, k in ((1, 0), (-1, 1)):
                m, cut, against = sign * margins[mine], sign * cuts[mine][k], sign * cuts[other][1 - k]
                rows = np.flatnonzero(free[other] & (m >= cut) & (sign * margins[other] > against))
                take.append(rows[np.argsort(-m[rows], kind="stable")][: int(grow * shares[k] * len(pool_t)) + 1])
            rows, labels = np.concatenate(take), np.repeat([1.0, 0.0], [len(t) for t in take])
            free[other][rows] = False
            given[other] = (np.concatenate([given[other][0], pool[other][rows]]), np.concatenate([given[other][1], labels]))
            moved.append(len(rows))
        exchanged.append((moved[0], moved[1]))
        if not any(moved):
            break
    margin = lambda v, rows: model[v].margin(x[v][rows])[:, None]
    scale_a, scale_b = (Logistic.fit(margin(v, scale), y[scale], 0.1) for v in ("text", "meta"))
    both = Logistic.fit(np.column_stack([scale_a.margin(margin("text", mix)), scale_b.margin(margin("meta", mix))]), y[mix], 0.1)
    return CoTrained(model["text"], model["meta"], scale_a, scale_b, both, exchanged)


def _features(docs: DataFrame) -> DataFrame:
    """Compact features of docs, with doc_id, label and hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                t, m = views(part)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.astype(np.float32).ravel())) for v in (t, m)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("hash"), *lists], names=["doc_id", "label", "hash", "t", "m"])

    return docs.select("doc_id", "label", F.col(f"{OWN}h").alias("hash"), "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(tidy(run), "doc_id long, label int, hash long, t array<float>, m array<float>")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, pool: int = 20_000, **options) -> CoTrained | None:
    """Co-train on at most about `sample` labelled rows (doc_id, quality) and `pool` unlabelled documents; None without both classes.

    Which rows are taken depends on hashes of doc_id and text alone; rows equal
    in both count once, and rows that repeat a labelled doc_id all bear its
    label and share its bound. Labels of null doc_id or quality are ignored; of
    a doc_id's labels the smallest counts.
    """
    model = _fitted(docs, labels, sample, pool, options)
    released()  # the sample has gone from the driver
    return model


def _fitted(docs: DataFrame, labels: DataFrame, sample: int, pool: int, options: dict) -> CoTrained | None:
    small_batches(docs.sparkSession)
    one = 1 << 30
    part = lambda n, most, salt, *c: F.pmod(F.xxhash64(F.lit(salt), *c), F.lit(one)) < int(min(1.0, most / max(1, n)) * one)
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    marked = stage(marked.filter(part(labels.count(), sample, 1, F.col("doc_id"))), "marked", sample)  # about `sample` rows, broadcast
    size = docs.select("doc_id").join(F.broadcast(marked), "doc_id", "left").agg(F.count("*"), F.count("label")).first()
    known = F.col("label").isNotNull()
    rows = docs.drop("label").join(F.broadcast(marked), "doc_id", "left")
    rows = rows.filter((known & part(size[1], sample, 3, "doc_id", "text")) | (~known & part(size[0], pool, 2, "doc_id", "text")))
    chosen = rows.withColumn(f"{OWN}h", F.xxhash64("text")).dropDuplicates(["doc_id", f"{OWN}h"])
    rows = _features(chosen).orderBy("doc_id", "hash").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    # flat buffers, never lists of numbers: the sample is all that the driver holds
    t, m = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) for c in ("t", "m"))
    known = rows.column("label").is_valid().to_numpy(zero_copy_only=False)
    y = rows.column("label").drop_null().to_numpy().astype(float)
    if len(y) < 16 or any(len(np.unique(y[np.arange(len(y)) % 8 == k])) < 2 for k in (1, 4, 6)):
        return None
    return co_train(t[known], m[known], y, t[~known], m[~known], **options)


def score_quality(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """docs with p_text, p_meta, score (probability of good quality) and keep (score >= threshold).

    docs has doc_id, text, lang, source and n_chars, all of which may be null:
    a null text counts as empty, null lang and source are values of their own,
    a null n_chars is 0. Texts without a word say nothing and are kept with
    score 0.5. Without a model everything is kept with score 0.5. Columns named
    like the added ones are replaced.
    """
    docs = without(docs, _ADDED)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p_text double, p_meta double, score double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in parts:
            out = np.full((len(text), 3), 0.5)
            for lo in range(0, len(text), 512):
                s = slice(lo, lo + 512)
                batch = pa.RecordBatch.from_arrays([pa.array(text[s], pa.large_string(), from_pandas=True), pa.array(lang[s], pa.string(), from_pandas=True), pa.array(source[s], pa.string(), from_pandas=True), pa.array(n_chars[s], pa.int64(), from_pandas=True)], names=["text", "lang", "source", "n_chars"])
                if held.value is not None:
                    out[s] = np.column_stack(held.value.score(*views(batch)))
            yield pd.DataFrame(out, columns=["p_text", "p_meta", "score"])
        released()

    silent = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) == 0
    out = docs.withColumn(f"{OWN}s", score("text", "lang", "source", F.col("n_chars").cast("long")))
    out = out.withColumns({"p_text": F.col(f"{OWN}s.p_text"), "p_meta": F.col(f"{OWN}s.p_meta"), "score": F.when(silent, 0.5).otherwise(F.col(f"{OWN}s.score"))}).drop(f"{OWN}s")
    return out.withColumn("keep", F.col("score") >= threshold)
