import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from boxstats.llm import alignment
from boxstats.llm.tokens import tokenizer_path
from tests.llm.data import SCHEMA, documents, frame, same

ODD = ["  two  spaces ", " x", "x ", "\n a \n\nb", "a　 b 　c  d  e \u0085 f   g", "<|endoftext|> <s> a</s>", "x▁y z", "▁", "日本 語 ßß",
       "e ́a 😀 👍🏽 \U0001f468‍\U0001f469", "it's I'LL 12 3a4!!??", "\x1c \x1d\x00 \x01", "a\t b\r\n c", "x" * 300 + " " + "é" * 200, " ", "  ", "~", "it 's 're"]


def brute(texts):
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = alignment.byte_alphabet()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    rows, total = [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw_a = [names[i] for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            rows.append(None)
            continue
        ends_a, ends_b = [], []
        for raw, ends in ((raw_a, ends_a), (raw_b, ends_b)):
            at = 0
            for r in raw:
                at += len(r)
                ends.append(at)
        where = {e: j for j, e in enumerate(ends_b)}
        links = [(i, where[e]) for i, e in enumerate(ends_a) if e in where]
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids_a[x : i + 1])) + "|" + ",".join(map(str, ids_b[y : j + 1])))
            x, y = i + 1, j + 1
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        total.update(pairs)
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0,) * 6 + ("",))
        else:
            out.append((*r[:4], sum(total[p] == most[p[1]] for p in r[4]), sum(total[p] for p in r[4]), r[5]))
    return out, [(i, j, n, n == most[j]) for (i, j), n in total.items()]


def test_galloping_finds_the_common_values():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(200), rng.randint(0, 120))) for _ in range(2))
        i, j = alignment.common_ends(np.array(a, np.int64), np.array(b, np.int64))
        assert list(zip(i, j)) == [(a.index(x), b.index(x)) for x in a if x in set(b)]


@pytest.mark.parametrize("known", [alignment.KNOWN, 40, 0])
def test_alignment_equals_whole_texts_of_the_libraries(spark, monkeypatch, known):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "SUMMED", 300)
    rows = documents() + [(2000 + i, t, "en", "s1", None) for i, t in enumerate(ODD)] + [(3000 + i, "hot words here", "en", "s1", None) for i in range(60)]
    want, pairs = brute([r[1] for r in rows])
    docs, found = alignment.align(frame(spark, rows, clash=True), known=known)
    same(docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect(), [(r[0], *w) for r, w in zip(rows, want)])
    same(found.collect(), pairs)


def test_empty_table(spark):
    docs, pairs = alignment.align(spark.createDataFrame([], SCHEMA))
    assert docs.collect() == [] and pairs.collect() == []


def test_a_long_text_without_spaces(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdeé") for _ in range(60_000))
    (want,), _ = brute([text])
    (got,) = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].collect()
    assert (got.n_a, got.n_b, got.n_groups, got.groups_sha256) == (want[0], want[1], want[2], want[6])
