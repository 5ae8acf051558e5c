"""Token ids in binary blocks: an adaptive context-mixing range coder.

A block holds whole documents and can be read alone: its models start empty, and its body and its
ids carry checksums. The probability of the next id is a mixture of three predictions: the id that last
followed the two ids before it, the id that last followed the one before it, and the frequencies of
ids so far. The weights of the mixture are counts of which prediction came true, kept for every
combination of the confidences of the first two. A carryless range coder spends the logarithm of
that probability.

The ids of a block are cut into ``lanes`` stretches that advance together, each with a coder of its
own but all with the same models, so that one numpy call serves all lanes. Models learn after each
step, the frequencies every ``REFRESH`` steps, in the same order when writing and reading.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, REFRESH = 8192, 16
MAGIC = b"CMR1"
_HEAD = "<4sIIIII"
_MIX_BITS, _FREQ_BITS = 12, 20
_HASH_BITS = 18
_CONF = 8
_U = np.uint64
_TOP, _BOTTOM, _WORD = _U(1 << 48), _U(1 << 32), _U(16)


class _Models:
    """The three predictions and the weights of their mixture, for all lanes of one block."""

    def __init__(self, size: int, lanes: int):
        self.size = size
        self.one = np.full(size, -1, np.int32)
        self.one_conf = np.zeros(size, np.int32)
        self.two = np.full(1 << _HASH_BITS, -1, np.int32)
        self.two_conf = np.zeros(1 << _HASH_BITS, np.int32)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.won = np.tile(np.array([2, 2, 12], np.int64), (2 * _CONF * _CONF, 1))
        self.count = np.zeros(size, np.int64)
        self.news: list[np.ndarray] = []
        self.steps = 0
        self._frequencies()

    def _frequencies(self) -> None:
        # Every id keeps a share of the scale, the rest follows the counts.
        total = int(self.count.sum())
        free = (1 << _FREQ_BITS) - self.size
        freq = 1 + (self.count * free // total if total else np.full(self.size, free // self.size))
        freq[0] += (1 << _FREQ_BITS) - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
        self.owner = None

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose shares of the scale hold the values, from a table over the whole scale."""
        if self.owner is None:
            self.owner = np.repeat(np.arange(self.size, dtype=np.int32), self.freq.astype(np.int64))
        return self.owner[value]

    def predict(self, m: int):
        """Predicted ids of the first ``m`` lanes, and where their parts of the mixture end."""
        self.key = (self.before[:m] * 0x9E3779B1 + self.last[:m] * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - _HASH_BITS)
        two, one = self.two[self.key], self.one[self.last[:m]]
        self.context = (self.two_conf[self.key] * _CONF + self.one_conf[self.last[:m]]) * 2 + (two == one)
        won = self.won
        total = won.sum(axis=1)
        scale = (1 << _MIX_BITS) - 3
        first = 1 + won[:, 0] * scale // total
        second = first + 1 + won[:, 1] * scale // total
        self.two_id, self.one_id = two, one
        return two, one, first[self.context].astype(np.uint64), second[self.context].astype(np.uint64)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        m = len(ids)
        self.won += np.bincount(self.context * 3 + outcome, minlength=self.won.size).reshape(self.won.shape)
        if self.steps & 63 == 63:
            self.won = (self.won >> 1) + 1
        hit = ids == self.two_id
        conf = self.two_conf[self.key]
        self.two_conf[self.key] = np.where(hit, np.minimum(conf + 1, _CONF - 1), conf >> 1)
        self.two[self.key] = np.where(hit | (conf > 1), self.two_id, ids)
        at = self.last[:m]
        hit = ids == self.one_id
        conf = self.one_conf[at]
        self.one_conf[at] = np.where(hit, np.minimum(conf + 1, _CONF - 1), conf >> 1)
        self.one[at] = np.where(hit | (conf > 1), self.one_id, ids)
        self.before[:m] = at
        self.last[:m] = ids
        self.news.append(ids[outcome == 2])
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps < REFRESH:
            self.count += np.bincount(np.concatenate(self.news), minlength=self.size)
            self.news = []
            self._frequencies()


def _lanes_of(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def _active(n: int, lanes: int, width: int):
    """Number of lanes that still have an id at each step; shorter lanes come last."""
    long = n - lanes * (width - 1)
    return [lanes] * (width - 1) + [long]


def _order(n: int, lanes: int, width: int) -> np.ndarray:
    """Places of the first id of each lane: lanes of full width first."""
    long = n - lanes * (width - 1)
    size = np.where(np.arange(lanes) < long, width, width - 1)
    return np.cumsum(size) - size


def encode(ids: np.ndarray, size: int) -> bytes:
    """One block; ``size`` is the number of possible ids."""
    ids = np.ascontiguousarray(ids, np.int32)
    n = len(ids)

    def whole(lanes, body):
        return struct.pack(_HEAD, MAGIC, n, size, lanes, zlib.crc32(ids.astype("<u4")), zlib.crc32(body)) + body

    if not n:
        return whole(0, b"")
    lanes, width = _lanes_of(n)
    first = _order(n, lanes, width)
    models = _Models(size, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    lane_out, word_out = [], []
    for step, m in enumerate(_active(n, lanes, width)):
        now = ids[first[:m] + step]
        two, one, a, b = models.predict(m)
        outcome = np.where(now == two, 0, np.where(now == one, 1, 2))
        lo, part = low[:m], span[:m] >> _U(_MIX_BITS)
        begin = np.where(outcome == 0, _U(0), np.where(outcome == 1, a, b))
        end = np.where(outcome == 0, a, np.where(outcome == 1, b, _U(1 << _MIX_BITS)))
        lo = lo + part * begin
        part = part * (end - begin)
        rest = np.flatnonzero(outcome == 2)
        fine = part[rest] >> _U(_FREQ_BITS)
        lo[rest] += fine * models.start[now[rest]]
        part[rest] = fine * models.freq[now[rest]]
        _shift(lo, part, lane_out, word_out)
        low[:m], span[:m] = lo, part
        models.learn(now, outcome)
    for k in range(4):
        lane_out.append(np.arange(lanes))
        word_out.append((low >> _U(48 - 16 * k)) & _U(0xFFFF))
    lane, word = np.concatenate(lane_out), np.concatenate(word_out).astype("<u2")
    order = np.argsort(lane, kind="stable")
    sizes = np.bincount(lane, minlength=lanes).astype("<u4").tobytes()
    return whole(lanes, sizes + word[order].tobytes())


def _shift(low: np.ndarray, span: np.ndarray, lane_out: list | None, word_out: list | None):
    """Moves out the words that are settled. Returns (lanes, after) for a reader that follows."""
    moved = []
    while True:
        same = (low ^ (low + span)) < _TOP
        # A span too short to go on that still crosses a word border is cut at the border.
        short = ~same & (span < _BOTTOM)
        if short.any():
            span[short] = (_U(0) - low[short]) & (_BOTTOM - _U(1))
            # Just below a border nothing may be left; then the whole word below it is taken.
            gone = short & (span == 0)
            span[gone] = _BOTTOM - _U(1)
        at = np.flatnonzero(same | short)
        if not len(at):
            return moved
        if lane_out is not None:
            lane_out.append(at)
            word_out.append(low[at] >> _U(48))
        moved.append(at)
        low[at] <<= _WORD
        span[at] <<= _WORD


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; raises when they do not fit their checksum."""
    magic, n, size, lanes, crc, coded = struct.unpack_from(_HEAD, block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[struct.calcsize(_HEAD) :]) != coded:
        raise ValueError("not a block of ids, or a damaged one")
    out = np.zeros(n, np.int32)
    if n:
        sizes = np.frombuffer(block, "<u4", lanes, struct.calcsize(_HEAD)).astype(np.int64)
        words = np.concatenate([np.frombuffer(block, "<u2", -1, struct.calcsize(_HEAD) + 4 * lanes), np.zeros(4, "<u2")]).astype(np.uint64)
        read = np.cumsum(sizes) - sizes
        code = np.zeros(lanes, np.uint64)
        for _ in range(4):
            code = (code << _WORD) | words[read]
            read += 1
        width = -(-n // lanes)
        first = _order(n, lanes, width)
        models = _Models(size, lanes)
        low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        for step, m in enumerate(_active(n, lanes, width)):
            two, one, a, b = models.predict(m)
            lo, part = low[:m], span[:m] >> _U(_MIX_BITS)
            value = (code[:m] - lo) // part
            outcome = np.where(value < a, 0, np.where(value < b, 1, 2))
            begin = np.where(outcome == 0, _U(0), np.where(outcome == 1, a, b))
            end = np.where(outcome == 0, a, np.where(outcome == 1, b, _U(1 << _MIX_BITS)))
            lo = lo + part * begin
            part = part * (end - begin)
            now = np.where(outcome == 0, two, one)
            rest = np.flatnonzero(outcome == 2)
            fine = part[rest] >> _U(_FREQ_BITS)
            value = np.minimum((code[rest] - lo[rest]) // fine, _U((1 << _FREQ_BITS) - 1))
            found = models.find(value)
            now[rest] = found
            lo[rest] += fine * models.start[found]
            part[rest] = fine * models.freq[found]
            for at in _shift(lo, part, None, None):
                code[at] = (code[at] << _WORD) | words[read[at]]
                read[at] += 1
            low[:m], span[:m] = lo, part
            out[first[:m] + step] = now
            models.learn(now, outcome)
    if zlib.crc32(out.astype("<u4")) != crc:
        raise ValueError("a block of ids is damaged")
    return out
