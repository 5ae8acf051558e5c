import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from boxstats.llm import prefixtrie
from tests.llm.data import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, family):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:]) if family else tuple(own[c])
    members, children = defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(120):
        for t in range(rng.choice([0, 1, 2, 3, 6, 25])):
            text = rng.choice(["a b", "a b", "c", "", None, "x　y z"]) if t < 5 else "k " * (t % 3)
            rows.append((c * 3 - 40, rng.choice([t, t, t, None]), rng.choice(["u", "u", None]), text))
    rows += [(1000 + i, t, "u", "hot") for i in range(60) for t in range(3)]
    rows += [(5, 0, "u", "long " * 100_000), *rows[:15], (None, 1, "u", "zz"), (2001, None, None, None)]
    return rows


@pytest.mark.parametrize("family, size", [(20, 100_000), (20, 40), (None, 5)])
def test_trie_equals_brute_force(spark, family, size):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' AS key", "1 AS depth", "'y' AS chain", "2 AS n_convs")
    got = prefixtrie.trie(df, family, trie_turns=size)
    assert got.columns == COLUMNS
    same(got.collect(), brute(rows, family))


def test_empty_tables_and_chunks(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.trie(empty, 20).collect() == []
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 4)
    rows = [(i * 7, 0, "u", "same") for i in range(50)]
    same(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows, None))


def test_two_fattest_is_the_number_of_most_factors_two():
    for low in range(40):
        for high in range(low + 1, 70):
            assert prefixtrie.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda f: f & -f)


def test_search_finds_the_exit_node_in_few_steps():
    rng = random.Random(5)
    words = np.ones(400, np.int64)

    def chain(letters):
        out = b""
        for x in letters:
            out += hashlib.blake2b(out[-16:] + bytes([x]), digest_size=16).digest()
        return out

    texts = {tuple(rng.randint(0, 1) if rng.random() < 0.1 else 0 for _ in range(rng.randint(0, 300))) for _ in range(120)}
    kept = [chain(t) for t in texts]
    tree = prefixtrie.ZFast()
    for i in range(0, len(kept), 17):
        tree.insert([(k, words[: len(k) // 16], 1, i) for k in kept[i : i + 17]])
    looked = []

    class Counted(dict):
        def get(self, key):
            looked.append(key)
            return super().get(key)

    tree.handles = Counted(tree.handles)
    for t in [*texts, *(tuple(rng.randint(0, 1) for _ in range(50)) for _ in range(50))]:
        x = chain(t)
        looked.clear()
        node = tree.locate(x, tree.root)
        assert len(looked) <= 2 * (len(t) + 1).bit_length()
        longest = max(prefixtrie.shared(x, k) for k in kept)
        assert tree.common(node, x) == longest and (not longest or node.above < longest)
