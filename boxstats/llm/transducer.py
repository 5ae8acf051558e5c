"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic machines replace the merge loop. The first cuts text into words: whether a word
begins at a character follows from the classes of a few characters around it, so every chunk of
text yields its cuts at once. The second reads the bytes of a word; its state holds what later bytes
can still change (for every suffix that a vocabulary entry could start with: the entry's node in
the vocabulary trie, the token before it, and how many tokens were out by then), and a transition
carries the number of tokens that it adds, which may be negative. States are compiled when first
met, up to ``MAX_STATES``, and thrown away when they are too many, so memory is bounded.

A word starts in the first state whatever came before, so the map of a chunk that begins with a
word takes every state to the same one, and chunk maps compose by adding counts: counts of whole
texts are differences of one prefix sum.

That a token sequence is the tokenizer's own can be told from its neighbours: undoing merges on both
sides of a border from the latest, no earlier merge may apply across it.

Null and empty texts have no tokens. Texts that hold a special string are cut there, as the library
does by default. Long texts are counted whole; a long word runs byte by byte. Repeated rows are rows of
their own, and an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.llm.text import once, runs, utf8
from boxstats.llm.tokens import tokenizer_path

MAX_STATES = 250_000
#: Words whose count a Python worker remembers.
REMEMBERED = 400_000
BYTE_TOKENIZER = "byte_bpe_50k.json"
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# The packed count of an entry, when it is 0, and the bits below the node.
_NONE_OUT, _REST = 1 << 19, (1 << 40) - 1
#: The characters that count as white space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a word of its own.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts tokens of single words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        vocab = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k.encode() not in self.special}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        # Tokens are numbered by their merge, single bytes first.
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256) if bytes([b]) in vocab}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merge: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = (bytes(alphabet[c] for c in x) for x in (left, right))
            number = len(self.parts)
            pair = (self.token[a], self.token[b])
            self.merge.setdefault(pair, number)
            self.parts.append(pair)
            self.token.setdefault(a + b, number)
        # Trie of tokens: children by node * 256 + byte, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        for text, number in self.token.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.ends[node] = number
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is a tuple of entries: node, token before (plus 1) and tokens out less those out
        # now, packed into one number.
        self.states: list[tuple] = [(_NONE_OUT,)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.step: dict[int, int] = {}

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether the tokenizer leaves these two tokens side by side."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            found = self._undo(left, right)
            if len(self.fits) > 400_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _undo(self, left: int, right: int) -> bool:
        # Merges earlier than ``limit`` come before the merges already undone. Of two merges with
        # one number the left one comes first.
        limit = len(self.parts)
        while True:
            merged = self.merge.get((left, right))
            if merged is not None and merged < limit:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def _compile(self, state: int, byte: int) -> int:
        grown, token, out = [], -1, 0
        for entry in self.states[state]:
            node = self.child.get(entry >> 40 << 8 | byte, -1)
            if node < 0:
                continue
            if self.inner[node]:
                grown.append(node << 40 | entry & _REST)
            end = self.ends[node]
            if end >= 0:
                before = (entry >> 20 & 0xFFFFF) - 1
                if before < 0 or self._neighbours(before, end):
                    token, out = end, (entry & 0xFFFFF) - _NONE_OUT + 1
        target = (*(entry - out for entry in grown), (token + 1) << 20 | _NONE_OUT)
        number = self.number.get(target)
        if number is None:
            number = len(self.states)
            self.states.append(target)
            self.number[target] = number
        move = number << 16 | (out + 0x8000)
        self.step[state << 8 | byte] = move
        return move

    def count(self, word: bytes) -> int:
        state = total = 0
        step = self.step
        for byte in word:
            move = step.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
            state = move >> 16
            total += (move & 0xFFFF) - 0x8000
        if len(self.states) > MAX_STATES:
            self._reset()
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) + len(words) > REMEMBERED:
            self.words = {}
        known = self.words
        for word in words:
            if word not in known:
                known[word] = self.count(word)
        return np.array([known[w] for w in words], np.int64)


def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    out[major == ord("L")] = _LETTER
    out[major == ord("N")] = _NUMBER
    out[_WHITE] = _SPACE
    return out


def word_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character; ``first`` marks where segments begin."""
    n = len(points)
    kind = classes[points]
    joined = ~first  # the character before belongs to the same segment
    before = np.concatenate([[_OTHER], kind[:-1]]).astype(np.uint8)
    blank = np.concatenate([[False], points[:-1] == 0x20]) & joined
    follows = np.concatenate([joined[1:], [False]])
    after = np.concatenate([kind[1:], [_SPACE]]).astype(np.uint8)
    space = kind == _SPACE
    # The last space of a run before something else stands apart from the rest of the run.
    last = follows & (after != _SPACE)
    start = np.where(space, (before != _SPACE) | last, ~blank & (before != kind)) | first
    mark = np.flatnonzero(points == 0x27)
    mark = mark[first[mark] | ((before[mark] != _OTHER) & ~blank[mark])]
    for ending in _ENDINGS:
        size = len(ending)
        fit = mark[mark + size < n]
        for j, c in enumerate(ending):
            fit = fit[(points[fit + 1 + j] == ord(c)) & joined[fit + 1 + j]]
        start[fit + 1] = False
        close = fit[fit + size + 1 < n] + size + 1
        start[close] |= True
    return start


def count_tokens(texts: pa.Array, machine: Transducer, classes: np.ndarray) -> np.ndarray:
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    raw = bytes(data)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    width = np.ones(len(points), np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    first = np.zeros(len(points) + 1, bool)
    rows = np.searchsorted(place, offsets)
    first[rows] = True
    specials = []
    for text in machine.special:
        at = raw.find(text)
        while at >= 0:
            row = np.searchsorted(offsets, at, side="right") - 1
            if at + len(text) <= offsets[row + 1]:
                specials.append((at, at + len(text)))
                at = raw.find(text, at + len(text))
            else:
                at = raw.find(text, at + 1)
    for a, b in specials:
        first[np.searchsorted(place, [a, b])] = True
    start = word_starts(points, first[:-1], classes)
    for a, b in specials:
        i, j = np.searchsorted(place, [a, b])
        start[i + 1 : j] = False
    cuts = np.concatenate([place[:-1][start], [len(data)]])
    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    coded = words.dictionary_encode()
    found = machine.counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    if specials:
        found[np.searchsorted(cuts, [a for a, _ in specials])] = 1
    total = np.concatenate([[0], np.cumsum(found)])
    bound = np.searchsorted(cuts, offsets)
    return total[bound[1:]] - total[bound[:-1]]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_tokens, over_limit. Other columns are not read."""
    path = path or tokenizer_path(BYTE_TOKENIZER)

    def work(batches):
        machine = once(("transducer", path), lambda: Transducer(path))
        classes = once("classes", _classes)
        for whole in batches:
            for batch in runs(whole):
                texts = batch.column("text")
                n = count_tokens(texts, machine, classes)
                _, offsets = utf8(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
