import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from boxstats.llm import idcoder, idfiles, packing, transducer
from boxstats.llm.text import once
from boxstats.llm.tokens import WordIds, tokenizer_path
from tests.llm.data import SCHEMA, documents, frame, same

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(tokenizer_path(WORDS))


@pytest.fixture(scope="module")
def byte_machine():
    path = tokenizer_path(BYTES)
    return Tokenizer.from_file(path), once(("transducer", path), lambda: transducer.Transducer(path)), once("classes", transducer._classes)


ODD = ["", "  ", "<|endoftext|>x <|startoftext|>", "x<|endoftext|>", "İSTANBUL ΣΑΣ Σ", "e ́a ﬁ Å", "日本 語", "\x1c\x1d a\x85b", "it's I'LL 12 3a4!!??", "~ a~b ~~",
       "don't, x.'s 'tis,'s é, ×, ÷. ŷ; ſ! ǆ, a—,b a…! 12.5,7 x_y <|endoftext|>,x,<|endoftext|> e\u0301, a,\u0301b Σ. ΑΣ, K, it's,it's"]


def test_word_ids_are_the_library_s(word_library):
    texts = [*ODD, *(r[1] or "" for r in documents())]
    ids, offsets = WordIds(tokenizer_path(WORDS)).encode(pa.array([*texts, None]), 7)
    for i, found in enumerate(word_library.encode_batch(texts, add_special_tokens=False)):
        assert list(ids[offsets[i] : offsets[i + 1]]) == [*found.ids, 7]
    assert list(ids[offsets[-2] :]) == [7]


@pytest.mark.parametrize("n", [0, 1, 63, 130, 3000, 40_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), rng.zipf(1.3, n) % 49_408, np.zeros(n, int), np.arange(n) % 7):
        assert (idcoder.decode(idcoder.encode(ids.astype(np.int32), 49_408)) == ids).all()


def test_repeats_cost_little_and_damage_is_seen():
    ids = (np.arange(200_000) % 50).astype(np.int32)
    block = idcoder.encode(ids, 49_408)
    assert len(block) < len(ids) / 2
    broken = bytearray(block)
    broken[-len(block) // 3] ^= 0x55
    with pytest.raises(ValueError):
        idcoder.decode(bytes(broken))


@pytest.mark.parametrize("block_ids", [4_000_000, 900])
def test_id_files(spark, word_library, block_ids):
    rows = documents()
    found = word_library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)
    ids = [[*x.ids, 2] for x in found]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, zlib.crc32((rows[i][1] or "").encode())))
    expected, start = [], 0
    for i in order:
        expected.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    same(idfiles.round_trip(frame(spark, rows, clash=True), block_ids=block_ids).collect(), expected)


def test_id_files_of_no_rows(spark):
    assert idfiles.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_covers_every_piece(spark, word_library):
    rows = documents()
    got = packing.pack_documents(frame(spark, rows, clash=True)).collect()
    ids = [[*x.ids, 1] for x in word_library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    pieces = []
    for row, x in zip(rows, ids):
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            pieces.append((row[0], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    same([r[:5] for r in got], pieces)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(map(len, ids)) // 4096) + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def _fewest(lengths, capacity):
    """Fewest bins by trying every placement."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in sorted({r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values()):
            place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_dominance_loses_no_optimum():
    rng = np.random.default_rng(2)
    for _ in range(150):
        capacity = int(rng.integers(6, 40))
        lengths = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = packing.reduce_by_dominance(count, capacity)
        rest = [x for x in range(capacity, 0, -1) for _ in range(count[x])]
        assert sum(t for _, t in fixed) + _fewest(rest, capacity) == _fewest(lengths, capacity)


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(3)
    for size in (1, 40, 3000):
        lengths = np.minimum(rng.lognormal(5, 1.5, size).astype(int) + 1, 4096)
        seen = Counter()
        for pattern, times in packing.plan(Counter(lengths.tolist()), 4096):
            assert sum(a * b for a, b in pattern) <= 4096
            for length, copies in pattern:
                seen[length] += copies * times
        assert seen == Counter(lengths.tolist())


def test_token_counts_are_the_library_s(spark, byte_machine):
    library, machine, classes = byte_machine
    rng = np.random.default_rng(5)
    pool = ["'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", " ", "a", "Hello", "don't", "12", "３", "!!", "<|endoftext|>", "é", "日本", "́", "x'S", "   \n", "😀", "aaaaaaaaaaaaaa", "====="]
    texts = ["".join(rng.choice(pool, rng.integers(0, 14))) for _ in range(1500)]
    texts += ["".join(chr(c) for c in rng.integers(0xA0, 0x3000, 15)) for _ in range(300)]
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert transducer.count_tokens(pa.array(texts), machine, classes).tolist() == expected
    rows = documents()
    counts = [len(x.ids) for x in library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    got = transducer.token_counts(frame(spark, rows, clash=True)).collect()
    same(got, [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, counts)])
    assert transducer.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_few_states_give_the_same_counts(byte_machine, monkeypatch):
    library, _, classes = byte_machine
    monkeypatch.setattr(transducer, "MAX_STATES", 40)
    machine = transducer.Transducer(tokenizer_path(BYTES))
    texts = [r[1] or "" for r in documents(4, 30)]
    expected = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert transducer.count_tokens(pa.array(texts), machine, classes).tolist() == expected
