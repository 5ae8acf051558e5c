"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

Only for tokenizers that drop white space and never look across it, such as ``word_bpe_49k.json``:
there the ids of a text are those of its pieces between ASCII white space, one after the other. The
pieces are cut once more where punctuation follows a letter or digit, which is a border for such a tokenizer too.
Words of a batch are told apart by their bytes, and found again by a digest of 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from boxstats.llm.text import once, space_mask, utf8, word_bounds

#: Distinct words that a Python worker remembers.
REMEMBERED = 2_000_000
MARK, WORD_END = "~", "</w>"
#: Up to here a letter stays one letter in lower case, but for the dotted capital I.
LAST_PLAIN = "\u024f"
#: New words that the library encodes as one text.
ROW_WORDS = 20_000
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters.encode())] = True
    return table


# Without the apostrophe, which may begin a contraction, and without what special strings are written with.
_PUNCTUATION = _bytes('!"#$%&()*+,-./:;=?@[]^_`{}~' + chr(92))
_ALPHANUMERIC = _bytes("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class WordIds:
    """Encodes batches of texts; keeps the ids of words between batches.

    Words are known by the first half of their digest in sorted arrays and by the second half beside their
    entry, some 33 bytes a word: a long table, and a short one of late words that is merged into it now and then.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        # Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self):
        self.count = 0
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.ids = np.zeros(1 << 16, np.uint16)
        self.begin = np.zeros(1 << 16, np.int64)
        self.check = np.zeros(1 << 16, np.uint64)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Appends entries of new words; the places of the words in the order of their entries.

        Words go to the library many as one text. A word of letters only is one word to the library as well, so it ends
        with the one token of it that closes a word; others are kept apart by a one-token mark that none holds.
        """
        plain = [i for i, w in enumerate(words) if w.isalpha() and max(w) <= LAST_PLAIN and "İ" not in w]
        parts = [self._closed([words[i] for i in plain[k : k + ROW_WORDS]]) for k in range(0, len(plain), ROW_WORDS)]
        known = set(plain)
        rest = [i for i in range(len(words)) if i not in known]
        odd = [i for i in rest if MARK in words[i]]
        marked = [i for i in rest if MARK not in words[i]]
        if marked:
            parts.append(self._marked([words[i] for i in marked]))
        for i in odd:
            ids = np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.int64)
            parts.append((ids, np.array([len(ids)])))
        ids, length = (np.concatenate(x) for x in zip(*parts))
        if len(ids) and ids.max() > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        n = self.count
        self.count += len(words)
        while self.count + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
            self.check = np.concatenate([self.check, np.zeros(len(self.check), np.uint64)])
        start = int(self.begin[n])
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[start : start + len(ids)] = ids
        self.begin[n + 1 : self.count + 1] = start + np.cumsum(length)
        return np.array(plain + marked + odd, np.int64)

    def _closed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that one closing token each ends, and their numbers."""
        (found,) = self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) != len(words):
            return self._marked(words)
        return ids, np.diff(ends, prepend=-1)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (found,) = self.library.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(words) - 1:
            raise RuntimeError("the tokenizer looks across white space")
        return ids[ids != self.mark], np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entries of digests, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, entries in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = (keys[at] == hashes) & (self.check[entries[at]] == checks)
                out[hit] = entries[at[hit]]
        return out

    def _keep(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        long, late = self.tables
        late = (np.concatenate([late[0], hashes]), np.concatenate([late[1], entries.astype(np.int32)]))
        if len(late[0]) > 100_000:
            long = (np.concatenate([long[0], late[0]]), np.concatenate([long[1], late[1]]))
            order = np.argsort(long[0])
            long = (long[0][order], long[1][order])
            late = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        else:
            order = np.argsort(late[0])
            late = (late[0][order], late[1][order])
        self.tables = [long, late]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) and their n + 1 offsets; ``end`` closes each text."""
        data, bounds = utf8(texts)
        n = len(bounds) - 1
        space = space_mask(data)
        starts, ends, rows = word_bounds(data, bounds, space)
        if len(cuts := _cuts(data, bounds)):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            rows = np.searchsorted(bounds, starts, side="right") - 1
        # The words without what lies between them, as one column.
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[~space])]).dictionary_encode()
        place, held = words.indices.to_numpy(), words.dictionary
        _, where, raw = held.buffers()
        where, raw = np.frombuffer(where, np.int32)[: len(held) + 1].tolist(), raw.to_pybytes() if raw is not None else b""
        distinct = [raw[a:b] for a, b in zip(where[:-1], where[1:])]
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), ">u8").astype(np.uint64).reshape(-1, 2)
        hashes, checks = np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])
        if self.count + len(distinct) > REMEMBERED:
            self._forget()
        order = np.argsort(hashes)
        entry = np.empty(len(distinct), np.int64)
        entry[order] = self._find(hashes[order], checks[order])
        new = np.flatnonzero(entry < 0)
        if len(new):
            first = self.count
            new = new[self._learn([distinct[i].decode() for i in new.tolist()])]
            entry[new] = np.arange(first, self.count)
            self.check[first : self.count] = checks[new]
            self._keep(hashes[new], entry[new])
        begin = self.begin[entry][place]
        length = (self.begin[entry + 1] - self.begin[entry])[place] if len(entry) else begin
        total = np.concatenate([[0], np.cumsum(length)])
        offsets = total[np.searchsorted(rows, np.arange(n + 1))]
        source = np.repeat(begin - total[:-1], length) + np.arange(total[-1])
        if end is None:
            return self.ids[source].astype(np.int32), offsets
        offsets = offsets + np.arange(n + 1)
        out = np.full(offsets[-1], end, np.int32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = self.ids[source]
        return out, offsets


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where punctuation follows an ASCII letter or digit, or a letter of U+00C0 to U+017F, in one text."""
    at = np.flatnonzero(_PUNCTUATION[data])
    at = at[at > 0]
    before = data[at - 1]
    lead = data[np.maximum(at - 2, 0)]
    wide = (at > 1) & (lead >= 0xC3) & (lead <= 0xC5) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    at = at[_ALPHANUMERIC[before] | wide]
    return at[~np.isin(at, bounds)]


def word_ids(path: str) -> WordIds:
    """This worker's encoder."""
    return once(("word ids", path), lambda: WordIds(path))
