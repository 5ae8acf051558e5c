"""Alignment of two tokenizers on whole texts, and how often their tokens meet in the corpus.

Both tokenizers cut the bytes of a space and the text. Offsets where both have a token's end are found
by galloping intersection of the two ascending end lists (``gallop``): the shorter list drives, and
every value is sought in the longer one by doubling steps and then by halving. Common indices slice
both token lists into groups; the differences of the ranks on both sides are the sizes of a group.
The last tokens of a group end together and are a link.

Both tokenizers cut at every single 0x20 between characters that are no white space (the byte-level
one by its pattern, the other because no piece holds a space after another character, which is
checked). So a text is the sequence of its units, from one such space to the next. Units are encoded
and aligned once and remembered by their text; when the store is full, those that the texts at hand
hold again stay. A unit may be a whole text without spaces; long ones go when the store is cleared.

Counts of id pairs take three steps: sums per task, their totals, and the highest count of every B id,
which are as many as B has ids. Counts reach the documents by broadcast for the most frequent pairs, at
most ``KNOWN`` of them (16 bytes each). All other pairs are below the count of these, so no key is
hot when they meet the documents in a shuffle join.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens:
zeros and an empty groups_sha256. Rows without doc_id and repeated rows are rows of their own. A long
text is one numpy run of some hundred bytes per byte of it. Ties for the highest count all count. An empty
table gives no rows. Columns of the input other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.llm.text import once, runs, short_batches, utf8
from boxstats.llm.tokens import tokenizer_path
from boxstats.storage import materialize

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units that a worker remembers, the longest of them, and new units encoded in a row.
REMEMBERED, REMEMBERED_BYTES, ROW_UNITS = 300_000, 64, 2000
#: Pairs whose counts are broadcast, and pairs that a task sums before it passes them on.
KNOWN, SUMMED = 1_000_000, 1_000_000
#: White space beyond ASCII; a cut next to it is not made.
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both of the values that two strictly ascending arrays have in common.

    Every value of ``short`` is sought in ``long`` from ``start`` on (0; no place of its value lies before), by steps
    that double until they pass it, and by halving within the last step. All values take their steps together.
    """
    n = len(long)
    low = np.zeros(len(short), np.int64) if start is None else start.astype(np.int64)
    if not n or not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high, step = low.copy(), 1
    going = np.flatnonzero((high < n) & (long[np.minimum(high, n - 1)] < short))
    while len(going):
        low[going] = high[going] + 1
        high[going] += step
        step *= 2
        at = high[going]
        going = going[(at < n) & (long[np.minimum(at, n - 1)] < short[going])]
    high = np.minimum(high, n)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    found = np.flatnonzero((low < n) & (long[np.minimum(low, n - 1)] == short))
    return found, low[found]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray | None = None, start_b: np.ndarray | None = None):
    """(indices in a, indices in b) of the ends in both; the shorter list drives. ``start_a`` gives a place in a
    for every end of b, from which on it can be found, and ``start_b`` the like."""
    if len(ends_a) <= len(ends_b):
        return gallop(ends_a, ends_b, start_b)
    return gallop(ends_b, ends_a, start_a)[::-1]


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: a printable Latin-1 character for itself,
    characters from U+0100 on for the others, in their order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the units seen."""

    def __init__(self, byte_path: str, piece_path: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        # Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if " " in self.bytes_b[-1].decode(errors="replace").lstrip(" "):
                raise ValueError(f"piece {i} crosses a space")
        self.size_b = len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.digits = _digits(max(len(self.bytes_a), self.size_b))
        self._forget()

    def _forget(self) -> None:
        self.names: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.sides = [(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))] * 2

    def _append(self, good: np.ndarray, *new) -> None:
        """More entries: on both sides their numbers of tokens, ids, and whether the other side ends there too."""
        self.good = np.concatenate([self.good, good])
        self.sides = [
            (np.concatenate([begin, begin[-1] + np.cumsum(count)]), np.concatenate([ids, more]), np.concatenate([common, shared]))
            for (begin, ids, common), (count, more, shared) in zip(self.sides, new)
        ]

    def _ids(self, units: list[str]) -> tuple[list[int], list[int]]:
        """Ids of units in a row. The second tokenizer adds the first space itself."""
        text = "".join(units)
        (a,) = self.a.encode_batch_fast([text], add_special_tokens=False)
        return a.ids, self.b.encode(text[1:], num_threads=1)

    def _learn(self, units: list[str]) -> None:
        """Appends the entries of new units. Plain ones are encoded many in a row, since both tokenizers cut
        between them; those with white space at an end, next to which they may not, by themselves."""
        order = []
        plain = [i for i, u in enumerate(units) if len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and "▁" not in u]
        rest = sorted(set(range(len(units))) - set(plain))
        jobs = [plain[i : i + ROW_UNITS] for i in range(0, len(plain), ROW_UNITS)] + [[i] for i in rest]
        done = []
        while jobs:
            job = jobs.pop(0)
            names = [units[i] for i in job]
            a, b = self._ids(names)
            raw = "".join(names).encode()
            same = [b"".join([table[i] for i in ids]) == raw for table, ids in ((self.bytes_a, a), (self.bytes_b, b))]
            size = np.array([len(n.encode()) for n in names])
            if all(same):
                done.append((a, b, size))
                order += job
            elif len(job) > 1:
                jobs = [[i] for i in job] + jobs
            else:
                done.append(([], [], size * 0))
                order += job
        sizes = np.concatenate([x[2] for x in done])
        ids = [np.fromiter((i for x in done for i in x[k]), np.int32) for k in (0, 1)]
        ends = [np.cumsum(table[i]) for table, i in zip((self.length_a, self.length_b), ids)]
        edge = np.cumsum(sizes)
        upto = [np.searchsorted(e, edge, side="right") for e in ends]
        count = [np.diff(u, prepend=0) for u in upto]
        # The ends of one unit are sought among those of the same unit.
        begin = [u - c for u, c in zip(upto, count)]
        i, j = common_ends(*ends, np.repeat(begin[0], count[1]), np.repeat(begin[1], count[0]))
        shared = [np.zeros(len(x), bool) for x in ids]
        shared[0][i] = shared[1][j] = True
        good = sizes > 0
        if (good & ~(np.isin(edge, ends[0]) & np.isin(edge, ends[1]))).any():
            raise RuntimeError("a tokenizer does not cut where a unit ends")
        first = len(self.good)
        self._append(good, *zip(count, ids, shared))
        self.names.update((units[i], first + k) for k, i in enumerate(order))

    def entries(self, units: list[str]) -> np.ndarray:
        """The entry of every unit."""
        if len(self.names) + len(units) > REMEMBERED:
            # Those met again now are the frequent ones.
            names = [u for u in units if u in self.names and len(u) <= REMEMBERED_BYTES]
            kept = np.array([self.names[u] for u in names], np.int64)
            good, sides = self.good[kept], self._gather(kept)
            self._forget()
            self._append(good, *sides)
            self.names = {u: i for i, u in enumerate(names)}
        if new := [u for u in units if u not in self.names]:
            self._learn(new)
        return np.array([self.names[u] for u in units], np.int64)

    def _gather(self, entries: np.ndarray) -> list[tuple]:
        """On both sides the numbers of tokens of the entries, their ids and common ends."""
        out = []
        for begin, ids, common in self.sides:
            count = begin[entries + 1] - begin[entries]
            source = np.repeat(begin[entries] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            out.append((count, ids[source], common[source]))
        return out

    def texts(self, entries: np.ndarray, n: np.ndarray):
        """Texts of ``n`` entries each -> n_a, n_b, n_links, link codes, and the bytes of all groups with their ends."""
        (count_a, a, end_a), (count_b, b, end_b) = self._gather(entries)
        last_a, last_b = np.flatnonzero(end_a), np.flatnonzero(end_b)
        cut = np.concatenate([[0], np.cumsum(n)])

        def per_text(count):
            return np.diff(np.concatenate([[0], np.cumsum(count)])[cut])

        upto_a = np.cumsum(per_text(count_a))
        links = np.diff(np.searchsorted(last_a, upto_a), prepend=0)
        codes = a[last_a].astype(np.int64) * self.size_b + b[last_b]
        # In the order of groups, a's tokens before b's: each is moved by the other side's tokens before it.
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        before_b = np.concatenate([[0], last_b + 1])[group_a]
        place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + (last_a + 1)[group_b]
        ids = np.empty(len(a) + len(b), np.int32)
        mark = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        digits, width = self.digits
        rows = digits[ids]
        rows[:, -1] = mark
        used = np.arange(rows.shape[1]) >= rows.shape[1] - 1 - width[ids][:, None]
        n_a, n_b = per_text(count_a), per_text(count_b)
        ends = np.concatenate([[0], np.cumsum(width[ids] + 1)])[np.cumsum(n_a + n_b)]
        return n_a, n_b, links, codes, rows[used], ends


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``n``, flush right before one free byte, and how many they are."""
    width = np.array([len(str(i)) for i in range(n)], np.int8)
    most = int(width.max())
    table = np.zeros((n, most + 1), np.uint8)
    for k in range(most):
        table[:, most - 1 - k] = ord("0") + np.arange(n) // 10**k % 10
    return table, width


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: rows, and 0x20 between two characters that are no white space."""
    n = len(data)
    at = np.flatnonzero(data[1 : n - 1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
    at = at[(data[at - 1] > 0x20) & (data[at + 1] > 0x20)]
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)]).astype(np.int32)

    def wide(second, third, fourth):
        """Whether the bytes end, or begin, with an encoded wide space, as two bytes or as three."""
        two = ((second & 0x1F) << 6) | (third & 0x3F)
        three = ((second & 0x0F) << 12) | ((third & 0x3F) << 6) | (fourth & 0x3F)
        return np.where(second < 0xE0, np.isin(two, WIDE_SPACES) & (second >= 0xC2), np.isin(three, WIDE_SPACES) & (second < 0xF0))

    p = at + 3
    after = wide(padded[p + 1], padded[p + 2], padded[p + 3])
    lead = np.where(padded[p - 2] >= 0xC0, 2, 3)
    before = (padded[p - 1] >= 0x80) & wide(padded[p - lead], padded[p - lead + 1], padded[p - lead + 2])
    at = at[~after & ~before]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    edge[at] = True
    edge[n:] = False
    return np.flatnonzero(edge)


def _encode(byte_path: str, piece_path: str, narrow: bool):
    dtype = np.uint32 if narrow else np.int64

    def work(batches):
        aligner = once(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))
        for whole in batches:
            for batch in runs(whole):
                texts = batch.column("text")
                filled = pc.greater(pc.binary_length(texts), 0)
                data, offsets = utf8(pc.binary_join_element_wise("", texts, " "))
                data = np.ascontiguousarray(data)
                starts = unit_starts(data, offsets)
                ends = np.append(starts[1:], len(data)).astype(np.int32)
                places = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
                units = pa.Array.from_buffers(pa.string(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
                entries = aligner.entries(units.dictionary.to_pylist())[units.indices.to_numpy()]
                first = np.searchsorted(starts, offsets[:-1])
                n_units = np.diff(np.append(first, len(starts)))
                good = np.logical_and.reduceat(aligner.good[entries], first) & np.asarray(filled)
                kept = np.flatnonzero(good)
                n_a, n_b, links, codes, groups, ends = aligner.texts(entries[np.repeat(good, n_units)], n_units[kept])
                hashes = [""] * batch.num_rows
                view = memoryview(np.ascontiguousarray(groups))
                for i, low, high in zip(kept.tolist(), [0, *ends.tolist()], ends.tolist()):
                    hashes[i] = hashlib.sha256(view[low : high - 1]).hexdigest()
                sums = np.zeros((3, batch.num_rows), np.int64)
                sums[:, kept] = n_a, n_b, links
                # Every document's links, equal ones together.
                code, times, cut = _distinct(np.repeat(kept, links), codes, batch.num_rows, len(aligner.bytes_a) * aligner.size_b)
                code, times = code.astype(dtype), times.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), *(pa.array(x) for x in (*sums, sums[2])), pa.array(hashes, pa.string()),
                     *(pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()) for x in (code, times))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"],
                )

    return work


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of every row in order, how often each occurs, and where rows begin."""
    keys = np.sort(rows * size + codes)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at] % size, np.diff(np.append(at, len(keys))), np.searchsorted(keys[at], np.arange(n + 1) * size)


def _totals(narrow: bool):
    """Counts of the id pairs of a task."""
    dtype = np.uint32 if narrow else np.int64

    def work(batches):
        codes, counts = [], []

        def summed():
            code, place = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(place, np.concatenate(counts), len(code)).astype(np.int64)

        def out(code, n):
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

        held = 0
        for batch in batches:
            for column, kept, kind in ((0, codes, dtype), (1, counts, np.uint32)):
                kept.append(np.frombuffer(b"".join(batch.column(column).to_pylist()), kind))
            held += len(codes[-1])
            if held > 2 * SUMMED:
                code, n = summed()
                if len(code) > SUMMED:
                    yield out(code, n)
                    code, n = code[:0], n[:0]
                codes, counts, held = [code], [n], len(code)
        if held:
            yield out(*summed())

    return work


def _look_up(codes: np.ndarray, counts: np.ndarray, best: np.ndarray, narrow: bool):
    """n_best and count_sum of the pairs that are known here; the others are passed on."""
    dtype = np.uint32 if narrow else np.int64

    def work(batches):
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            rest, rest_times = [], []
            for i, (c, t) in enumerate(zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist())):
                code, times = np.frombuffer(c, dtype).astype(np.int64), np.frombuffer(t, np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                at, met = at[known], times[known]
                sums[:, i] = met[best[at]].sum(), (met * counts[at]).sum()
                rest.append(code[~known])
                rest_times.append(times[~known])
            columns = {name: batch.column(name) for name in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            columns |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            columns |= {"codes": pa.array(rest, pa.list_(pa.int64())), "times": pa.array(rest_times, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    return work


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """Documents with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, and the
    linked id pairs with a, b, n and best (whether n is the highest of b)."""
    byte_path, piece_path = byte_path or tokenizer_path(BYTE_TOKENIZER), piece_path or tokenizer_path(PIECE_TOKENIZER)
    spark = docs.sparkSession
    short_batches(spark)
    size_a, size_b = _sizes(byte_path, piece_path)
    narrow = size_a * size_b <= 2**32
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = materialize(rows.mapInArrow(_encode(byte_path, piece_path, narrow), f"{schema}, codes binary, times binary"))
    sums = found.select("codes", "times").mapInArrow(_totals(narrow), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    sums = materialize(sums)
    # One row per id of B.
    highest = sums.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))
    pairs = sums.withColumn("b", F.col("code") % size_b).join(F.broadcast(highest), "b")
    pairs = pairs.select("code", F.floor(F.col("code") / size_b).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))
    bits = F.length(F.bin("n"))
    spread = dict(sums.groupBy(bits).count().collect())
    least, total = max(spread, default=0) + 1, 0
    while least > 1 and total + spread.get(least - 1, 0) <= known:
        least -= 1
        total += spread.get(least, 0)
    hot = pairs.filter(bits >= least).select("code", "n", "best").toArrow()
    code, n, best = (hot.column(i).to_numpy() for i in range(3))
    order = np.argsort(code)
    lookup = _look_up(code[order], n[order], best[order].astype(bool), narrow)
    met = found.mapInArrow(lookup, f"{schema}, n_best long, count_sum long, codes array<long>, times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    result = pairs.select("a", "b", "n", "best")
    if least == 1:
        return met.select(*columns), result
    met = materialize(met)
    rest = met.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("t"))
    rest = rest.join(pairs.filter(bits < least).select("code", "n", "best"), "code")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_best"), F.sum(F.col("t") * F.col("n")).alias("_sum"))
    met = met.drop("codes", "times").join(rest, "row", "left")
    met = met.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return met.select(*columns), result


def _sizes(byte_path: str, piece_path: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_path).get_vocab_size(with_added_tokens=True), sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
