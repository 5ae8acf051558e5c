"""Quality rules: a hashed n-gram logistic regression beside plain counts of each text.

Words and character n-grams fall into hash buckets, a logistic regression on their shares is
trained on labelled rows, Platt scaling on rows held out of the fit turns its margin into a
probability, and whole texts are scored in Arrow batches against fixed thresholds.

Null and empty texts have no words, so the base rules reject them. Labels that are null, not 0
or 1, or that name no document are ignored; of repeated labels of a document the lowest counts.
Without labels of both classes the method keeps all that the base rules keep. Of rows that share a
labelled doc_id one is learned from. Long texts are counted whole, in one numpy run; repeated rows are
judged alike, each as its own row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.llm.text import Rolling, mix64, runs, space_mask, utf8, window_hashes, word_bounds

#: A document needs this many words, and at most this percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Calibrated probability of good quality from which on a document stays.
KEEP_FROM = 0.5
#: Labelled rows of each class that the fit sees at most.
SAMPLE_PER_CLASS = 2000
BITS = 17
FAMILIES = ("char3", "char4", "word", "word2")
_SYMBOLS = b"#*$%&|<>"

BASE_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -50, 50)))


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    n = len(offsets) - 1
    separator = space_mask(data)
    starts, ends, rows = word_bounds(data, offsets, separator)
    rolling = Rolling(data)
    words = rolling.spans(starts, ends)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    out = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": total(~separator & ((data & 0xC0) != 0x80)),
        "n_symbols": total(symbol[data]),
    }
    # Every text has one line more than newlines; begins and ends pair up in sorted order.
    newline = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    cuts = np.sort(np.concatenate([newline, offsets[1:]]))
    filled = np.concatenate([[0], np.cumsum(~separator, dtype=np.int64)])
    has_word = filled[cuts] > filled[begins]
    begins, cuts = begins[has_word], cuts[has_word]
    line_rows = np.searchsorted(offsets, begins, side="right") - 1
    lines = rolling.spans(begins, cuts)
    order = np.lexsort((lines, line_rows))
    again = (lines[order][1:] == lines[order][:-1]) & (line_rows[order][1:] == line_rows[order][:-1])
    out["n_dup_lines"] = np.bincount(line_rows[order][1:][again], minlength=n)
    windows, at = window_hashes(words, rows, 3)
    keyed = mix64(windows + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else windows
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    repeated = np.zeros(len(order) + 1, bool)
    repeated[1:-1] |= same if len(order) else False
    repeated[:-2] |= same if len(order) else False
    hit = np.zeros(len(words) + 2, bool)
    first = at[order[repeated[: len(order)]]]
    for j in range(3):
        hit[first + j] = True
    out["n_repeat_words"] = np.bincount(rows[hit[: len(rows)]], minlength=n)
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """(family, buckets, rows) of all n-grams; buckets of the families do not overlap."""
    starts, ends, word_rows = word_bounds(data, offsets, space_mask(data))
    words = Rolling(data).spans(starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = data.astype(np.uint32)
    shift = np.uint32(32 - BITS)
    for k, n in enumerate((3, 4)):
        at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
        gram = wide[at]
        for j in range(1, n):
            gram = gram | (wide[at + j] << np.uint32(8 * j))
        yield ((gram * np.uint32(0x9E3779B1)) >> shift).astype(np.int64) + (k << BITS), rows[at]
    yield (words >> np.uint64(64 - BITS)).astype(np.int64) + (2 << BITS), word_rows
    pairs, at = window_hashes(words, word_rows, 2)
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64) + (3 << BITS), word_rows[at]


def _sample(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` labelled rows of each class, those with the lowest hash of doc_id."""
    clean = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    if allowed is not None:
        clean = clean.filter(allowed)
    chosen = None
    for y in (0, 1):
        part = clean.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of two columns.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 7) -> QualityModel | None:
    """Train on at most ``2 * per_class`` labelled rows; None without rows of both classes."""
    sample = _sample(docs, labels, "quality", None, per_class, seed)

    def bags(batches):
        for whole in batches:
            for batch in runs(whole):
                data, offsets = utf8(batch.column("text"))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "y": batch.column("_y").cast(pa.int32()), "bag": _bags(data, offsets)}
                )

    rows = sample.select("doc_id", "_y", "text").mapInArrow(bags, "doc_id long, y int, bag binary").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return None
    body, offsets = utf8(rows.column("bag"))
    del rows
    packed, begin = np.frombuffer(body, [("f", "<i4"), ("v", "<f4")]), offsets // 8
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    prior = {v: 1 / (2 * max((y == v).mean(), 1e-9)) for v in (0.0, 1.0)}
    balance = np.array([prior[v] for v in y])
    groups = [
        (rows, packed[begin[rows[0]] : begin[rows[-1] + 1]], begin[rows[0] : rows[-1] + 2] - begin[rows[0]])
        for rows in (np.arange(i, min(i + 250, len(y))) for i in range(0, len(y), 250))
    ]
    weights, bias = _logistic(groups, y, np.where(held, 0, balance))
    margin = np.concatenate([_margin(weights, p, c) for _, p, c in groups]) + bias
    seen = held if held.any() else ~held
    scale, shift = _platt(margin[seen], y[seen], balance[seen])
    return QualityModel(weights.astype(np.float32), bias, scale, shift)


def _margin(weights: np.ndarray, packed: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(weights[packed["f"]] * packed["v"])])
    return total[begin[1:]] - total[begin[:-1]]


def _bags(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    n = len(offsets) - 1
    parts = []
    for buckets, rows in features(data, offsets):
        keys, count = np.unique((rows << 20) | buckets, return_counts=True)
        row = keys >> 20
        share = count / np.maximum(np.bincount(rows, minlength=n), 1)[row]
        parts.append((row, keys & ((1 << 20) - 1), share))
    row, bucket, share = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    packed = np.empty(len(order), [("f", np.int32), ("v", np.float32)])
    packed["f"], packed["v"] = bucket[order], share[order]
    cut = np.searchsorted(row[order], np.arange(n + 1))
    return [packed[cut[i] : cut[i + 1]].tobytes() for i in range(n)]


def _logistic(groups, y, balance, epochs: int = 60, rate: float = 4.0, decay: float = 1e-6):
    """Full-batch logistic regression with AdaGrad steps; rows of weight 0 are left out. A few rows
    are unpacked at a time, so only the packed sample fills memory."""
    size = len(FAMILIES) << BITS
    w, b, g2, gb2 = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    n = np.count_nonzero(balance)
    for _ in range(epochs):
        grad, lean = decay * w, 0.0
        for rows, packed, begin in groups:
            margin = _margin(w, packed, begin) + b
            slope = balance[rows] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[rows]) / n
            grad += np.bincount(packed["f"], weights=np.repeat(slope, np.diff(begin)) * packed["v"], minlength=size)
            lean += slope.sum()
        g2 += grad * grad
        gb2 += lean**2
        w -= rate * grad / np.sqrt(g2)
        b -= 0.1 * lean / np.sqrt(gb2)
    return w, b


def _platt(margin, y, balance, steps: int = 50):
    """Scale and shift of a logistic curve through held-out margins, by Newton steps with a ridge."""
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones(len(margin))], 1)
    smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        grad = x.T @ (balance * (p - smooth)) + 1e-3 * theta
        hess = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(theta[0] / spread), float(theta[1])


def margins(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.full(n, model.bias)
    for buckets, rows in features(data, offsets):
        total = np.bincount(rows, weights=model.weights[buckets], minlength=n)
        out += total / np.maximum(np.bincount(rows, minlength=n), 1)
    return out


def score(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id and text -> doc_id, the plain counts, base_failed, probability and kept.

    ``docs`` may have further columns of any name; they are not read.
    """

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                data, offsets = utf8(batch.column("text"))
                base = counts(data, offsets)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                p = model.probability(margins(model, data, offsets)) if model else np.ones(len(offsets) - 1)
                columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(v.astype(np.int64)) for k, v in base.items()}
                columns |= {"base_failed": pa.array(failed), "quality": pa.array(p), "kept": pa.array(~failed & (p >= keep_from))}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, f"doc_id long, {BASE_SCHEMA}, quality double, kept boolean"
    )


def keep(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``score`` would mark as kept."""

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                data, offsets = utf8(batch.column("text"))
                base = counts(data, offsets)
                good = (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= MAX_REPEAT_PERCENT * base["n_words"])
                if model:
                    good &= model.probability(margins(model, data, offsets)) >= keep_from
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
