"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of signs. A trigram of letters and word gaps is bound into
one vector: the first letter's vector rotated twice, times the second's rotated once, times the
third's. A text is the bundle (sum) of its trigram vectors, a language prototype the sum of the unit
vectors of its texts, and the language of a text the prototype of highest cosine.

Null texts and texts without a letter are ``und`` with score 0. Without a labelled text nothing can
be learned, and every text is ``und``. Ties go to the first language in code point order. The score
is the cosine, cut to 0..1. Long texts are bundled whole, in one numpy run; repeated rows are predicted
alike and each learned from; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.llm.text import once, runs, utf8

DIM = 1024
TASKS = 32
#: Letters beyond Latin-1 share this many symbols.
OTHERS = 64
_GAP = 0


def symbols(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of all letters, runs of anything else as one gap, and the offsets of rows.

    Every text is led and closed by a gap, so a text of one letter still has a trigram.
    """
    lower = pc.utf8_lower(pc.fill_null(text, ""))
    # A tab closes every text, so every text ends with a gap and texts cannot touch.
    lower = pc.binary_join_element_wise(lower, pa.scalar("\t", lower.type), pa.scalar("", lower.type))
    data, offsets = utf8(lower)
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = (data & 0xC0) != 0x80
    offsets = np.concatenate([[0], np.cumsum(lead)])[offsets]
    table = _letter_table()
    sym = table[np.minimum(points, len(table) - 1)].astype(np.int32)
    far = points >= len(table)
    if far.any():
        sym[far] = [_far(chr(c)) for c in points[far]]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != _GAP) | (sym[:-1] != _GAP)
    counts = np.concatenate([[0], np.cumsum(keep)])
    return sym[keep], counts[offsets]


def _far(c: str) -> int:
    return 256 + ord(c) % OTHERS if c.isalpha() else _GAP


def _letter_table() -> np.ndarray:
    def make():
        out = np.zeros(0x3000, np.int16)
        for c in range(len(out)):
            if chr(c).isalpha():
                out[c] = c if c < 256 else 256 + c % OTHERS
        return out

    return once("letters", make)


def _letters(dim: int) -> np.ndarray:
    """Random signs of every symbol, and their rotations by one and two places."""
    one = np.random.default_rng(977).integers(0, 2, (256 + OTHERS, dim)).astype(np.float32) * 2 - 1
    return np.stack([np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one])


def bundles(text: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """float32 [texts, dim] and whether a text has a letter."""
    sym, offsets = symbols(text)
    n, base = len(offsets) - 1, letters.shape[1]
    filled = np.concatenate([[0], np.cumsum(sym != _GAP)])
    has = filled[offsets[1:]] > filled[offsets[:-1]]
    rows = np.repeat(np.arange(n), np.diff(offsets))
    # A gap before the first symbol of each text comes from the tab that closes the one before it.
    sym = np.concatenate([[_GAP], sym]).astype(np.int64)
    code = (sym[:-2] * base + sym[1:-1]) * base + sym[2:] if len(sym) > 2 else np.zeros(0, np.int64)
    owner = rows[1:]
    start = offsets[:-1][np.diff(offsets) > 0]
    if len(code):
        # At the first symbol of a text the trigram would reach into the text before.
        good = np.ones(len(rows), bool)
        good[start] = False
        code, owner = code[good[1:]], owner[good[1:]]
    out = np.zeros((n, letters.shape[2]), np.float32)
    span = base**3
    keys, count = np.unique(owner * span + code, return_counts=True)
    grams, column = np.unique(keys % span, return_inverse=True)
    row = keys // span
    step = 2048
    order = np.argsort(column, kind="stable")
    row, column, count = row[order], column[order], count[order]
    for first in range(0, len(grams), step):
        g = grams[first : first + step]
        a, b = np.searchsorted(column, [first, first + len(g)])
        dense = np.zeros((n, len(g)), np.float32)
        dense[row[a:b], column[a:b] - first] = count[a:b]
        out += dense @ (letters[0][g // (base * base)] * letters[1][g // base % base] * letters[2][g % base])
    return out, has


def _slices(batch: pa.RecordBatch):
    for part in runs(batch, limit=1_000_000):
        for start in range(0, part.num_rows, 512):
            yield part.slice(start, 512)


def prototypes(labelled: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """doc_id, text, lang -> language names and unit vectors, from all texts with a language."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    schema = "lang string, body binary"

    def added(total):
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(total), pa.string()), "body": pa.array([v.astype("<f8").tobytes() for v in total.values()], pa.binary())}
        )

    def work(batches):
        letters = _letters(dim)
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in _slices(whole):
                body, has = bundles(batch.column("text"), letters)
                norm = np.linalg.norm(body, axis=1, keepdims=True)
                unit = body / np.maximum(norm, 1e-9)
                names = np.array(batch.column("lang").to_pylist(), object)
                for name in set(names[has]):
                    total[name] = total.get(name, 0) + unit[has & (names == name)].sum(axis=0, dtype=np.float64)
        yield from added(total)

    def merge(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
                total[name] = total.get(name, 0) + np.frombuffer(body, "<f8")
        yield from added(total)

    # Texts are summed where they are read. The sums, one row per language and task, meet in few
    # tasks, so the driver gets at most ``TASKS`` rows of a language.
    parts = rows.mapInArrow(work, schema).repartition(TASKS).mapInArrow(merge, schema).toArrow()
    sums: dict[str, np.ndarray] = {}
    for name, body in zip(parts.column("lang").to_pylist(), parts.column("body").to_pylist()):
        sums[name] = sums.get(name, 0) + np.frombuffer(body, "<f8")
    names = sorted(sums)
    if not names:
        return [], np.zeros((0, dim), np.float32)
    body = np.stack([sums[x] for x in names])
    return names, (body / np.linalg.norm(body, axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score. Other columns are not read."""
    dim = vectors.shape[1]

    def work(batches):
        letters = _letters(dim)
        for whole in batches:
            for batch in _slices(whole):
                body, has = bundles(batch.column("text"), letters)
                if names:
                    cosine = (body @ vectors.T) / np.maximum(np.linalg.norm(body, axis=1, keepdims=True), 1e-9)
                    best = cosine.argmax(axis=1)
                    score = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0)
                    lang = [names[i] if h else "und" for i, h in zip(best, has)]
                else:
                    lang, score = ["und"] * len(has), np.zeros(len(has))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score.astype(np.float64))}
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")
