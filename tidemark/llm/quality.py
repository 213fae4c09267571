"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, chunks, small_batches, staged, task, utf8

#: What is measured of a text; each is transformed so that its distribution has no long tail.
FEATURES = ("upper", "marks", "strange", "bangs", "bars", "digits", "repeats", "distinct", "commonest", "length", "spread", "lines", "lone", "words")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 mark, 4 strange mark
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4


def _share(part: np.ndarray, whole: np.ndarray, more: float = 8) -> np.ndarray:
    """The arcsine of the root of a share: even near 0 and 1 its spread hardly depends on it. `more` is added to the
    whole, so that a short text's shares say little."""
    return np.arcsin(np.sqrt(np.clip(part / (whole + more), 0, 1)))


def statistics(texts: list[bytes]) -> np.ndarray:
    """texts x FEATURES."""
    w = Words(texts)
    k = len(texts)
    size = np.array([len(t) for t in texts], np.float64)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    per_text = lambda flag: np.add.reduceat(flag, at[:-1], dtype=np.int64) if k else np.zeros(0)
    per_word = lambda flag: np.bincount(w.doc, weights=flag, minlength=k)
    kind, letters = _KIND[w.buf], per_text(_LETTER[w.buf])
    n = w.n.astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    last, first = w.buf[np.maximum(w.end - 1, 0)], w.buf[np.minimum(w.start, len(w.buf) - 1)]
    again = np.zeros(len(w.doc))
    if len(again) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(new)
    distinct = np.bincount(d[starts], minlength=k).astype(np.float64) if len(starts) else np.zeros(k)
    most = np.zeros(k)
    np.maximum.at(most, d[starts], np.diff(np.append(starts, len(h))))
    mean = per_word(length) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(per_word(length**2) / np.maximum(n, 1) - mean**2, 0))
    lines = per_text(w.buf == 10)  # with the one that ends each text
    whole = np.maximum(n, 1)
    out = np.stack(
        [
            _share(per_text(kind == 1), letters, 40),
            _share(per_text(kind == 3), size, 40),
            _share(per_text(kind == 4), size, 40),
            _share(per_word(last == 33), whole),
            _share(per_word((length == 1) & (first == 124)), whole),
            _share(per_text(kind == 2), size, 40),
            _share(per_word(again), whole),
            np.log(whole) - np.log(np.maximum(distinct, 1)),
            _share(np.maximum(most - 1, 0), whole),
            np.log1p((mean * n + 40) / (n + 8)),
            np.log1p((spread * n + 24) / (n + 8)),
            np.log(lines / (n + 40)),
            _share(per_word(length == 1), whole),
            np.log1p(n),
        ],
        axis=1,
    )
    return out


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, features array<double>) and the columns of `keep` for every row, over its whole text (null: empty)."""
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw = utf8(b.column(1))
            for i, j in chunks(raw):
                x = statistics(raw[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, *(b.column(c).slice(i, j - i) for c in range(2, b.num_columns))], ["id", "features", *keep])

    return small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep).mapInArrow(task(run), f"id {kind}, features array<double>{', ' + ddl if ddl else ''}")


@dataclass
class Discriminant:
    """For each class: log prior, mean, and the inverse of the Cholesky factor of its shrunken covariance."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        x = np.clip(x, self.low, self.high)
        d = [self.prior[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def moments(labelled: DataFrame, label_col: str) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: rows, sums, sums of products, least and most. Summed in each partition, then once."""
    p = len(FEATURES)
    width = p + p * p

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, p)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in np.unique(y):
                own = x[y == k]
                s = np.concatenate((own.sum(axis=0), (own.T @ own).ravel()))
                n, t, low, high = held.get(int(k), (0, np.zeros(width), np.full(p, np.inf), np.full(p, -np.inf)))
                held[int(k)] = [n + len(own), t + s, np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([np.concatenate(v[1:]).tolist() for v in held.values()], pa.list_(pa.float64()))], ["k", "n", "s"])

    parts = labelled.select("features", F.col(label_col).cast("int").alias("k")).mapInArrow(task(run), "k int, n long, s array<double>")
    at = F.posexplode("s").alias("i", "v")
    total = F.sum("v")
    edge = F.when(F.col("i") < width, total).when(F.col("i") < width + p, F.min("v")).otherwise(F.max("v"))
    sums = parts.select("k", "n", at).groupBy("k", "i").agg(edge.alias("v"), F.sum("n").alias("n")).collect()
    out = {}
    for k in {r.k for r in sums}:
        own = sorted((r.i, r.v, r.n) for r in sums if r.k == k)
        v = np.array([x[1] for x in own])
        out[k] = (own[0][2], v[:p], v[p:width].reshape(p, p), v[width : width + p], v[width + p :])
    return out


def fit(labelled: DataFrame, label_col: str = "quality", shrinkage: float = 0.1) -> Discriminant:
    """The discriminant of rows with `features` and a label of 0 or 1, from their moments over all rows.

    Each class covariance is drawn by `shrinkage` towards the pooled one and its diagonal. Without rows of a class its moments are those
    of the other, so that the score is the prior; without any rows all scores are 0.5."""
    p = len(FEATURES)
    found = {k: v for k, v in moments(labelled, label_col).items() if k in (0, 1)}
    if not found:
        found = {1: (0, np.zeros(p), np.zeros((p, p)), np.zeros(p), np.zeros(p))}
    for k in (0, 1):
        if k not in found:
            n, s, q, low, high = found[1 - k]
            found[k] = (0, s, q, low, high) if n == 0 else (0, s / n, q / n, low, high)
    count = [found[k][0] for k in (0, 1)]
    mean, cov = [], []
    for k in (0, 1):
        n = max(1, found[k][0])
        m = found[k][1] / n
        mean.append(m)
        cov.append(found[k][2] / n - np.outer(m, m))
    pooled = sum(max(1, n) * c for n, c in zip(count, cov)) / sum(max(1, n) for n in count)
    scale = np.diag(np.diag(pooled)) + 1e-4 * np.eye(p)
    whiten, log_det = [], []
    for k in (0, 1):
        shrunk = (1 - shrinkage) * cov[k] + shrinkage * 0.5 * (pooled + scale) + 1e-6 * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    prior = np.array([math.log((n + 1) / (sum(count) + 2)) for n in count])
    return Discriminant(prior, np.array(mean), np.array(whiten), np.array(log_det), np.minimum(found[0][3], found[1][3]), np.maximum(found[0][4], found[1][4]))


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """`features` with a score; the model (some kB) travels with the task."""
    keep = [c for c in features.columns if c != "features"]
    p = len(FEATURES)

    def run(batches):
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, p)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(model.score(x))], [*keep, "score"])

    ddl = ", ".join(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep)
    return features.select(*keep, "features").mapInArrow(task(run), f"{ddl}, score double")


def learnt(x: DataFrame, labels: DataFrame, id_col: str, label_col: str, fold, shrinkage: float) -> Discriminant:
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
    return fit(x.where(~fold).join(y, F.col("id") == F.col("label_id")), "label", shrinkage)


def in_fold(folds: int, held_out: int):
    return F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_out, F.lit(False))


def classified(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, shrinkage: float = 0.1) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `df`; score is the probability that its label is 1.

    Learns from the labels of ids whose crc32, as text, modulo `folds` is not `held_out`, all of them: only their moments
    reach the driver. Every statistic covers the whole text; a null text counts as empty, and a text without words is
    scored by the same discriminant. Labels other than 0 and 1, null ones included, teach nothing; a document
    with several labels teaches each. A null id is never held out and has no label; repeated rows get
    equal results; an empty table gives an empty result. Without any label all scores are 0.5."""
    x = staged(measured(df, id_col, text_col), "quality")
    fold = in_fold(folds, held_out)
    model = learnt(x, labels, id_col, label_col, fold, shrinkage)
    return scored(x.withColumn("held_out", fold), model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, shrinkage: float = 0.1) -> DataFrame:
    """The rows of `df` that classified() predicts to have label 1, with its columns. Each is judged where it is read, so
    that no text is shuffled. Nulls, empty and long texts, repeated rows and empty tables are as in classified(): a null text counts as
    empty and stays null, and without any label all rows stay; other columns, whatever their names, pass through."""
    model = learnt(measured(df, id_col, text_col), labels, id_col, label_col, in_fold(folds, held_out), shrinkage)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            raw = utf8(b.column(at))
            for i, j in chunks(raw):
                yield b.slice(i, j - i).filter(pa.array(model.score(statistics(raw[i:j])) >= 0.5))

    return small_batches(df).mapInArrow(task(run), df.schema)
