"""Quality classifier (operator 6): a linear support-vector machine over n-gram indicators scaled by Naive Bayes
log-count ratios, fitted by dual coordinate descent on the hinge loss.

Indicators are hashed into a fixed number of columns: words, and runs of one to three word *shapes* (case,
symbols, digits, length, whether the word repeats the one before), with the order of magnitude of a shape's share.
The fit takes a bounded sample of labelled rows (``most``, a parameter): one task fits on all of it, and one for each of
``FOLDS`` folds on the rest, which gives every row a margin from a model that has not seen it.  Those margins set the sigmoid
that turns margins into scores.  Scoring is one pass over all texts; a score depends on nothing but its text.

Null and empty texts get the score of a text without indicators; repeated rows get equal scores.  Without labels
of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_sample
from .textops import list_array, mix, plainly_named, small_batches, texts_of, Words

FOLDS = 5

_KIND = np.ones(256, np.uint8)  # letters, and bytes of characters beyond ASCII
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4


def shapes(w: Words) -> np.ndarray:
    """A hash of the shape of each word."""
    kind = _KIND[w.data]
    length = w.ends - w.starts
    code = kind[w.starts].astype(np.int64) * 5 + kind[w.ends - 1]
    for k, most in ((2, 2), (3, 1), (4, 3)):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        n = total[w.ends] - total[w.starts]
        code = code * 5 + np.where((k == 2) & (n == length) & (length > 1), 4, np.minimum(n, most))
    code = code * 8 + np.minimum(np.log2(length).astype(np.int64), 7)
    return code


def indicators(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicator columns of each text, ascending: (columns, number per text)."""
    w = Words(texts)
    n, mask = len(w.starts), np.uint64((1 << bits) - 1)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    words = w.hashes()
    first = np.zeros(n, bool)
    first[w.first[:-1][w.counts > 0]] = True
    repeat = np.zeros(n, np.int64)
    repeat[1:] = (words[1:] == words[:-1]) & ~first[1:]
    shape = mix((shapes(w) * 2 + repeat).astype(np.uint64) + np.uint64(11))
    columns, owners = [words & mask], [text]
    run = shape
    for k in (1, 2, 3):
        inside = text[: len(run)] == text[k - 1 :]  # runs within one text
        columns.append(mix(run[inside] + np.uint64(k)) & mask)
        owners.append(text[: len(run)][inside])
        run = mix(run[: max(0, n - k)] * np.uint64(3) + shape[k:])
    pair = (text.astype(np.uint64) << np.uint64(32)) | (mix(shape + np.uint64(1)) >> np.uint64(32))
    seen, count = np.unique(pair, return_counts=True)
    owner = (seen >> np.uint64(32)).astype(np.int64)
    share = np.round(-np.log2(count / w.counts[owner])).astype(np.uint64)
    columns.append(mix(seen * np.uint64(64) + share ^ (owner.astype(np.uint64) << np.uint64(38))) & mask)
    owners.append(owner)
    both = np.unique((np.concatenate(owners).astype(np.int64) << bits) | np.concatenate(columns).astype(np.int64))
    return (both & ((1 << bits) - 1)).astype(np.int32), np.bincount(both >> bits, minlength=len(w.counts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's values, the same whatever texts stand beside it."""
    out, filled = np.zeros(len(counts)), counts > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, (np.cumsum(counts) - counts)[filled])
    return out


@dataclass
class Model:
    """Score of a text: sigmoid(slope * (sum of weights / length of the scaled vector + bias) + shift)."""

    bits: int
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        dot, square = (sums(v[columns].astype(np.float64), counts) for v in (self.weight, self.square))
        return dot / np.sqrt(np.maximum(square, 1e-12)) + self.bias

    def scores(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(columns, counts) + self.shift, -30, 30)))


def log_count_ratios(columns: np.ndarray, counts: np.ndarray, y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of the ratio of an indicator's share in label 1 to its share in label 0."""
    label = np.repeat(y, counts)
    p, q = (np.bincount(columns[label == k], minlength=size) + smooth for k in (1, 0))
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(columns: np.ndarray, counts: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Hinge-loss weights of unit-length scaled vectors with a bias; each step solves the dual for one row exactly.  Returns weights, bias, dual values and their limits."""
    cut = np.concatenate([[0], np.cumsum(counts)])
    rows = [columns[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    values = []
    for r in rows:
        x = ratio[r]
        values.append(x / max(np.sqrt((x * x).sum()), 1e-6))
    w, bias, alpha, sign = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    curve = np.array([(v * v).sum() + 1 for v in values])
    limit = cost * np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))  # both classes weigh the same
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            r, v, s = rows[i], values[i], sign[i]
            slope = s * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / curve[i], 0.0), limit[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[r] += step * s * v
                bias += step * s
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias, alpha, limit


def sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton steps on softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum(), g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def one_class(y: np.ndarray, bits: int) -> Model:
    """Without rows of both classes: every score is the share of label 1."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    return Model(bits, np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def fit(columns: np.ndarray, counts: np.ndarray, y: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 15) -> Model:
    """The margins; the sigmoid is still to be set."""
    ratio = log_count_ratios(columns, counts, y, 1 << bits)
    w, bias, _, _ = dual_coordinate_descent(columns, counts, y, ratio, cost, epochs)
    return Model(bits, (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)


def folds(y: np.ndarray) -> np.ndarray:
    """The fold of each row: both classes are dealt in turn to as many folds as each has rows for."""
    n = min(FOLDS, int((y == 0).sum()), int((y == 1).sum()))
    out = np.zeros(len(y), np.int64)
    for k in (0, 1):
        out[y == k] = np.arange((y == k).sum()) % max(n, 1)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8000, bits: int = 18) -> Model:
    """Fit on at most ``most`` labelled rows.  A task holds their indicators; the driver gets 2**bits weights and a margin a row."""
    sample = training_sample(docs, labels, label, most)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            columns, counts = indicators(batch.column("text"), bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), list_array(columns, counts, pa.int32())], names=["doc_id", "label", "columns"])

    def task(table: pa.Table) -> pa.Table:
        """Fold -1 fits on all rows; another one on all but its own, for which it returns margins."""
        table = table.sort_by("doc_id")
        part, lists, y = table.column("part")[0].as_py(), table.column("columns").combine_chunks(), table.column("label").to_numpy().astype(np.int64)
        counts, columns = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        fold = folds(y)
        own = fold == part
        weight, square, bias, margins = b"", b"", 0.0, np.empty(0)
        if part < 0 and y.min() < y.max():
            m = fit(columns, counts, y, bits)
            weight, square, bias = m.weight.tobytes(), m.square.tobytes(), m.bias
            if fold.max() == 0:  # a class of one row: no folds
                own, margins = np.ones(len(y), bool), m.margins(columns, counts)
        elif part >= 0 and own.any() and not own.all():
            held = np.repeat(own, counts)
            margins = fit(columns[~held], counts[~own], y[~own], bits).margins(columns[held], counts[own])
        seen = y[own] if len(margins) else y if part < 0 and not weight else y[:0]
        return pa.table({"weight": pa.array([weight], pa.binary()), "square": pa.array([square], pa.binary()), "bias": pa.array([bias]), "margins": pa.array([margins.tolist()], pa.list_(pa.float64())), "labels": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    parts = F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias("part")
    rows = sample.mapInArrow(read, "doc_id long, label int, columns array<int>").select("*", parts)
    got = rows.groupBy("part").applyInArrow(task, "weight binary, square binary, bias double, margins array<double>, labels array<long>").collect()
    y = np.array([x for r in got for x in r.labels], np.int64)
    whole = [r for r in got if r.weight]
    if not whole:
        return one_class(y, bits)
    model = Model(bits, np.frombuffer(whole[0].weight, np.float32), np.frombuffer(whole[0].square, np.float32), whole[0].bias, 1.0, 0.0)
    model.slope, model.shift = sigmoid(np.array([x for r in got for x in r.margins]), y)
    return model


def score(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights and their squares: a fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            got = shared.value.scores(*indicators(batch.column("text"), shared.value.bits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], schema=schema)

    scored = texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns.  Null texts and texts without words are rejected; rows that repeat an id
    or are equal are judged one by one; an empty table gives an empty result."""
    shared, plain, text = docs.sparkSession.sparkContext.broadcast(model), plainly_named(docs), f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            columns, counts = indicators(batch.column(text), shared.value.bits)
            yield batch.filter(pa.array((shared.value.scores(columns, counts) >= threshold) & (counts > 0)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 8000) -> DataFrame:
    return score(docs, train(docs, labels, "quality", most), threshold)
