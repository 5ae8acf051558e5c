"""Suffix-array dedup: removes every byte that lies in a string of ``length`` bytes seen elsewhere.

A suffix for every byte would be many times the corpus, so the suffix array is sparse. Each
``length``-byte window has an anchor, the leftmost ``GRAM``-byte string of least hash inside it.
Equal windows have their anchors at equal places, so only windows around equal anchors can match,
and anchors are few (about 2 / (length - GRAM) of all bytes).

1. Runs of windows with one anchor become one row: hashes of the anchor and of the whole run.
2. A run that occurs twice repeats with all its windows. Anchors that occur twice with different
   runs around them (the edges of repeated passages) need their bytes; one run of each kind is kept.
3. Those suffixes are range-partitioned by their leading bytes at the anchor, with splitters that
   Spark samples. In each bucket a multikey sort on characters of five bytes takes the windows apart
   until only equal ones stay together. Anchors with more than ``HOT_RUNS`` different runs are dealt
   over all buckets, and their windows are compared across the boundaries by hash.

Whole runs and windows of such anchors are equal when their 62-bit hashes are; the rest is compared byte
by byte. Null and empty texts have no bytes and are kept as they are. Equal rows of one doc_id match
each other as any two texts do. Rows are told apart by doc_id and 128 bits of the SHA-256 of their
text; rows that agree in both lose the same bytes. Long texts are cut whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from boxstats.llm.text import Rolling, give_back, mix64, runs, utf8
from boxstats.storage import materialize

LENGTH, GRAM = 200, 50
#: Anchors with more different runs than this are compared across buckets.
HOT_RUNS = 4000
#: Bytes of one bucket, and of the suffixes that are sorted together.
BUCKET_BYTES, SORT_BYTES = 2_000_000, 1_000_000
_CHARACTER = 5


def _anchors(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, length: int, gram: int):
    """(row, first window, last window, anchor) of every run, places counted in ``data``."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    place = np.arange(n - gram + 1)
    bits = max(24, int(n).bit_length())
    least = rolling.spans(place, place + gram) >> np.uint64(bits) << np.uint64(bits) | place.astype(np.uint64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    window = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    if not len(window):
        return none, none, none, none
    anchor = (least[window] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    low, high = window[first], window[np.concatenate([first[1:] - 1, [len(window) - 1]])]
    return row[low].astype(np.int64), low, high, anchor[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _runs_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text_key, text -> one row per run: place, windows and anchor (from the run's start),
    hash of the anchor and hash of the run."""

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                data, offsets = utf8(batch.column("text"))
                rolling = Rolling(data)
                row, low, high, anchor = _anchors(data, offsets, rolling, length, gram)
                key = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(key), batch.column("text_key").take(key), pa.array(low - offsets[row]),
                        pa.array((high - low + 1).astype(np.int32)), pa.array((anchor - low).astype(np.int32)),
                        _signed(rolling.spans(anchor, anchor + gram)),
                        _signed(mix64(rolling.spans(low, high + length) + (anchor - low).astype(np.uint64))),
                    ],
                    ["doc_id", "text_key", "low", "windows", "anchor", "hk", "hu"],
                )

    return docs.mapInArrow(work, "doc_id long, text_key binary, low long, windows int, anchor int, hk long, hu long")


def _packed(docs: DataFrame) -> DataFrame:
    """The texts in compressed form (as ``body``), for shuffles that must carry them."""

    def work(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = pa.array([press.compress(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
            others = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in others), body], [*others, "body"])
            give_back()

    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(work, StructType([*kept, StructField("body", BinaryType())]))


def _suffixes(edges: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the edge runs, once per task for rows that repeat a doc_id and its text."""
    spans = edges.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("hk", "low", "windows", "anchor", "open", "hot")).alias("spans")
    )
    # Bounded by the length of a document, as one run of each kind is kept.
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "spans")
    texts = _packed(docs)
    met = texts.join(spans, texts["doc_id"].eqNullSafe(F.col("_d")) & (texts["text_key"] == F.col("_t")))

    def work(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        seen = set()
        for batch in batches:
            out = {x: [] for x in ("doc_id", "text_key", "hk", "low", "anchor", "open", "hot", "lead", "bytes")}
            for doc, crc, body, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "body", "spans"))):
                key = (doc, crc)
                if key in seen:
                    continue
                seen.add(key)
                text = press.decompress(body)
                for s in spans:
                    part = text[s["low"] : s["low"] + s["windows"] + length - 1]
                    lead = part[s["anchor"] : s["anchor"] + min(gram, 16)]
                    for k, v in zip(out, (doc, crc, s["hk"], s["low"], s["anchor"], s["open"], s["hot"], lead, part)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("doc_id", pa.int64()), ("text_key", pa.binary()), ("hk", pa.int64()), ("low", pa.int64())] + [("anchor", pa.int32()), ("open", pa.bool_()), ("hot", pa.bool_()), ("lead", pa.binary()), ("bytes", pa.binary())]
            ))

    return met.select("doc_id", "text_key", "body", "spans").mapInArrow(
        work, "doc_id long, text_key binary, hk long, low long, anchor int, open boolean, hot boolean, lead binary, bytes binary"
    )


def multikey_classes(data: np.ndarray, starts: np.ndarray, classes: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``length``-byte strings at ``starts`` equal another one of their class.

    Multikey sort: strings that agree so far are sorted by their next character of five bytes, and
    only those that still have an equal go on to the character after it.
    """
    padded = np.concatenate([data, np.zeros(_CHARACTER, np.uint8)]).astype(np.uint64)
    characters = np.zeros(len(data), np.uint64)
    for j in range(_CHARACTER):
        characters = (characters << np.uint64(8)) | padded[j : j + len(data)]
    alive = np.arange(len(starts))
    _, current = np.unique(classes, return_inverse=True)
    for depth in range(0, length, _CHARACTER):
        count = np.bincount(current)
        keep = count[current] > 1
        alive, current = alive[keep], current[keep]
        if not len(alive):
            break
        _, current = np.unique(current, return_inverse=True)
        take = min(_CHARACTER, length - depth)
        key = (current.astype(np.uint64) << np.uint64(40)) | (characters[starts[alive] + depth] >> np.uint64(8 * (_CHARACTER - take)))
        order = np.argsort(key)
        new = np.zeros(len(key), np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        current = np.empty(len(key), np.int64)
        current[order] = np.cumsum(new)
    out = np.zeros(len(starts), bool)
    if len(alive):
        count = np.bincount(current)
        out[alive[count[current] > 1]] = True
    return out


def _windows(batch: pa.Table, length: int):
    """data, starts, row and number in its run of every window."""
    data, offsets = utf8(batch.column("bytes"))
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(batch.num_rows), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return data, offsets[row] + number, row, number


_SPAN = "doc_id long, text_key binary, low long, windows int"


def _spans(batch: pa.Table, row: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """Runs of adjoining windows as (doc_id, text_key, low, windows)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(row)]]))
    key = pa.array(row[first])
    take = lambda c: batch.column(c).take(key).combine_chunks()
    low = take("low").to_numpy() + number[first]
    return pa.RecordBatch.from_arrays(
        [*(x if isinstance(x, pa.Array) else x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (take("doc_id"), take("text_key"))), pa.array(low), pa.array(size.astype(np.int32))],
        ["doc_id", "text_key", "low", "windows"],
    )


def _cut(batches, limit: int = SORT_BYTES):
    """Batches sorted by (lead, hk), dealt into lists of about ``limit`` bytes of suffixes.

    Only suffixes of one anchor (one hk) must stay together; anchors with one lead need not.
    """
    held, size, last = [], 0, None
    for batch in batches:
        keys = list(zip(batch.column("lead").to_pylist(), batch.column("hk").to_pylist()))
        cut = 0
        for i in range(len(keys)):
            if size >= limit and keys[i] != last:
                if i > cut:
                    held.append(batch.slice(cut, i - cut))
                yield held
                held, size, cut = [], 0, i
            size += len(batch.column("bytes")[i].as_buffer())
            last = keys[i]
        held.append(batch.slice(cut))
    if held and size:
        yield held


def _sort_buckets(suffixes: DataFrame, length: int, buckets: int) -> DataFrame:
    """Windows of the open edge runs that another run of their anchor has, as spans."""
    dealt = suffixes.repartitionByRange(buckets, "lead", "hk").sortWithinPartitions("lead", "hk")

    def settle(held):
        batch = pa.Table.from_batches(held)
        data, starts, row, number = _windows(batch, length)
        anchor = batch.column("anchor").to_numpy()
        _, group = np.unique(batch.column("hk").to_numpy(), return_inverse=True)
        # Equal windows have their anchor at the same place.
        same = group[row] * (length + 1) + (anchor[row] - number)
        hit = multikey_classes(data, starts, same, length) & batch.column("open").to_numpy(zero_copy_only=False)[row]
        return _spans(batch, row[hit], number[hit])

    def work(batches):
        for held in _cut(batches):
            yield settle(held)
        give_back()

    return dealt.mapInArrow(work, _SPAN)


def _across_buckets(suffixes: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different runs: windows meet by hash."""

    def work(batches):
        for whole in batches:
            for batch in runs(whole, "bytes"):
                data, starts, row, number = _windows(batch, length)
                hashes = Rolling(data).spans(starts, starts + length)
                key = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashes), batch.column("doc_id").take(key), batch.column("text_key").take(key),
                     pa.array(batch.column("low").to_numpy()[row] + number), batch.column("open").take(key)],
                    ["window", "doc_id", "text_key", "low", "open"],
                )

    rows = suffixes.mapInArrow(work, "window long, doc_id long, text_key binary, low long, open boolean")
    twice = rows.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("window")
    return rows.filter("open").join(twice, "window", "left_semi").select("doc_id", "text_key", "low", F.lit(1).alias("windows"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, text_key, text -> (doc_id, text_key, low, windows): starts of repeated strings."""
    table = materialize(_runs_table(docs, length, gram))
    # Written, so that the join below may split the partition of an anchor that is everywhere.
    twice = materialize(table.groupBy("hk").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("hk"))
    met = materialize(table.join(twice, "hk"))
    kinds = materialize(
        met.groupBy("hk", "hu").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "low", "windows", "anchor")).alias("one"))
    )
    whole = met.join(kinds.filter("n > 1").select("hk", "hu"), ["hk", "hu"], "left_semi").select("doc_id", "text_key", "low", "windows")
    anchors = kinds.groupBy("hk").agg(F.count(F.lit(1)).alias("_kinds"), F.min("n").alias("_least")).filter("_kinds > 1 AND _least = 1")
    edges = kinds.join(anchors, "hk").select("hk", "one.*", (F.col("n") == 1).alias("open"), (F.col("_kinds") > hot_runs).alias("hot"))
    suffixes = materialize(_suffixes(edges, docs, length, gram))
    facts = suffixes.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)), F.coalesce(F.max("hot"), F.lit(False))).first()
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, int(facts[0] // BUCKET_BYTES))
    parts = whole.unionByName(_sort_buckets(suffixes.filter("NOT hot"), length, buckets))
    if facts[1]:
        parts = parts.unionByName(_across_buckets(suffixes.filter("hot"), length))
    return parts


def _lists(spans: DataFrame) -> DataFrame:
    """Spans as (_d, _t, low, windows), one row per doc_id and text_key with sorted lists.

    Rows that repeat a doc_id and its text bring equal spans; a set keeps one of each, so a list is
    bounded by the length of a document.
    """
    sets = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("low", "windows"))).alias("spans"))
    return sets.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("spans.low").alias("low"), F.col("spans.windows").alias("windows"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that
    remain), kept_text (those bytes without the halves of cut characters), and rest (a struct of the
    columns in ``carry``)."""
    rest = F.struct(*carry) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest")
    ).withColumn("text_key", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    spans = repeated_spans(rows.drop("rest"), length, gram, hot_runs)
    spans = _lists(spans)
    texts = _packed(rows)
    met = texts.join(spans, texts["doc_id"].eqNullSafe(F.col("_d")) & (texts["text_key"] == F.col("_t")), "left")

    def cut(text, low, windows):
        """What remains, the number of bytes taken out and of runs of them."""
        begin = np.array(low)
        end = np.maximum.accumulate(begin + np.array(windows) + length - 1)
        first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(begin) - 1]])
        kept, at = [], 0
        for a, b in zip(begin[first].tolist(), end[last].tolist()):
            kept.append(text[at:a])
            at = b
        kept = b"".join([*kept, text[at:]])
        return kept, len(text) - len(kept), len(first)

    def work(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
                for body, low, windows in zip(*(batch.column(c).to_pylist() for c in ("body", "low", "windows"))):
                    text = press.decompress(body)
                    kept, removed, number = cut(text, low, windows) if low else (text, 0, 0)
                    for k, v in zip(out, (len(text), removed, number, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                        out[k].append(v)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds)), batch.column("rest")], ["doc_id", *out, "rest"]
                )
            give_back()

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, rest {rows.schema['rest'].dataType.simpleString()}"
    return met.select("doc_id", "body", "low", "windows", "rest").mapInArrow(work, schema)
