import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxstats.llm import jaccard, mixing, suffixes, topk
from tests.llm.data import SCHEMA, WORD, documents, frame, prose, same


def _repeated(rows, length):
    seen = defaultdict(list)
    raw = [(r[1] or "").encode() for r in rows]
    for d, body in enumerate(raw):
        for p in range(len(body) - length + 1):
            seen[body[p : p + length]].append((d, p))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = b"\1" * length
    for row, body, flags in zip(rows, raw, gone):
        kept = bytes(x for x, f in zip(body, flags) if not f)
        runs = sum(1 for k in range(len(flags)) if flags[k] and (k == 0 or not flags[k - 1]))
        yield row[0], len(body), sum(flags), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "gram", "hot"), [(60, 15, 4000), (60, 15, 2), (200, 50, 4000)])
def test_suffix_dedup(spark, length, gram, hot):
    rows = documents(2)
    got = suffixes.dedup(frame(spark, rows, clash=True), length, gram, hot, carry=("lang",))
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), _repeated(rows, length))
    assert Counter(r["lang"] for r in got.select("rest.lang").collect()) == Counter(r[2] for r in rows)


def test_suffix_dedup_of_no_rows(spark):
    assert suffixes.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_buckets_are_cut_between_anchors_of_one_lead():
    rows = [(b"x" * 16, k // 3, b"y" * 100) for k in range(300)]
    make = lambda part: pa.RecordBatch.from_pydict(dict(zip(("lead", "hk", "bytes"), map(list, zip(*part)))))
    held = [pa.Table.from_batches(x) for x in suffixes._cut([make(rows[:130]), make(rows[130:])], 1000)]
    assert [r for t in held for r in zip(*(t.column(c).to_pylist() for c in ("lead", "hk", "bytes")))] == rows
    anchors = [set(t.column("hk").to_pylist()) for t in held]
    assert sum(map(len, anchors)) == 100 and max(t.num_rows for t in held) <= 12


def test_suffix_dedup_of_templated_lines(spark):
    # All suffixes of these lines have one lead, and their anchors have a copy each.
    rng = np.random.default_rng(4)
    rests = ["".join(map(chr, rng.integers(97, 123, 120))) for _ in range(30)]
    rows = [(i, "0123456789 2026 ERROR " * 3 + rests[i % 30] + str(i), "en", "s", 1) for i in range(60)]
    got = suffixes.dedup(frame(spark, rows), 60, 15)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), _repeated(rows, 60))


def test_spans_of_repeated_rows_are_held_once(spark):
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 123, 500)))
    other = text[100:300] + "".join(map(chr, np.random.default_rng(7).integers(97, 123, 300)))
    rows = [(7, text, "en", "s", 1)] * 50 + [(None, text, "en", "s", 1)] * 50 + [(8, other, "en", "s", 1)]
    same(suffixes.dedup(frame(spark, rows), 60, 15).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), _repeated(rows, 60))
    docs = frame(spark, rows).coalesce(1).selectExpr("doc_id", "text", "substring(unhex(sha2(CAST(text AS BINARY), 256)), 1, 16) AS text_key")
    spans = suffixes.repeated_spans(docs, 60, 15)
    lists = suffixes._lists(spans).collect()
    for r in lists:
        assert len(r.low) == len(r.windows) == len(set(zip(r.low, r.windows))) <= 600
    crc = docs.filter("doc_id = 7").first().text_key
    edge = spark.createDataFrame([(7, crc, 3, 5, 10, 2, True, False)], "doc_id long, text_key binary, hk long, low long, windows int, anchor int, open boolean, hot boolean")
    found = suffixes._suffixes(edge, docs, 60, 15).collect()
    assert [bytes(r["bytes"]).decode() for r in found] == [text[5:74]]


def test_multikey_classes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(380)
    group = rng.integers(0, 3, 380)
    strings = [(int(g), data[s : s + 7].tobytes()) for s, g in zip(starts, group)]
    count = Counter(strings)
    assert suffixes.multikey_classes(data, starts, group, 7).tolist() == [count[s] > 1 for s in strings]


def _near_rows(seed=3, members=60):
    rng = np.random.default_rng(seed)
    rows = documents(seed, 60)
    core = [f"w{x}" for x in rng.integers(0, 900, 150)]
    for i in range(members):
        words = list(core)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            words[at] = f"z{rng.integers(0, 10**6)}"
        rows.append((2000 + i, " ".join(words), "en", "s1", 1))
    return [*rows, (2900, "a b", "en", "s1", 3), (2901, " a  b", "en", "s1", 3)]


def _groups(rows):
    shingles, copies = {}, Counter()
    for r in rows:
        words = WORD.findall(r[1] or "")
        if r[0] is not None:
            shingles[r[0]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            copies[r[0]] += 1
    ids = [i for i in shingles if shingles[i]]
    root, links = {i: i for i in shingles}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        links[i] += copies[i] - 1
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(shingles[a] & shingles[b])
            if common and common >= 0.8 * (len(shingles[a]) + len(shingles[b]) - common) - 1e-9:
                links[a] += copies[b]
                links[b] += copies[a]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(r[0], None if r[0] is None else find(r[0]), links[r[0]] if r[0] is not None else 0) for r in rows]


def test_jaccard_join(spark):
    rows = _near_rows()
    same(jaccard.join(frame(spark, rows, clash=True)).collect(), _groups(rows))


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    rows = _near_rows(4)
    same(jaccard.join(frame(spark, rows)).collect(), _groups(rows))


def test_jaccard_partitions_follow_shipped_rows(spark, monkeypatch):
    # A group of 60 near copies in blocks of 7 ships each class to many tasks.
    asked, plain = [], jaccard.verify

    def spy(blocks, similarity):
        asked.append((blocks.rdd.getNumPartitions(), blocks.count()))
        return plain(blocks, similarity)

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "SHIPPED_ROWS", 5)
    monkeypatch.setattr(jaccard, "verify", spy)
    rows = _near_rows(4)
    same(jaccard.join(frame(spark, rows)).collect(), _groups(rows))
    [(partitions, shipped)] = asked
    assert partitions == max(spark.sparkContext.defaultParallelism, shipped // 5) and shipped > 5 * 60


def test_jaccard_join_of_no_rows(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = jaccard.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_mix_meets_its_targets(spark):
    rows = documents(5, 400)
    got = mixing.mix(frame(spark, rows, clash=True)).collect()
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    same([(r.doc_id, r.size, r.taken) for r in got], [(r.doc_id, r.size, r.taken) for r in again])
    same([(r.doc_id, r.size) for r in got], [(r[0], len(WORD.findall(r[1] or ""))) for r in rows])
    total = sum(r.size for r in got)
    taken, target = Counter(), {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.target <= 3 * r.source_size
    assert sum(target.values()) == pytest.approx(total)
    assert sum(taken.values()) <= total
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in target)


def test_targets_share_what_limits_leave(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, None: 5, "d": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    held = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        free = sum(weight[s] for s in order if s not in held)
        over = {s for s in order if s not in held and weight[s] * left / free > 3 * sizes[s]}
        if not over:
            break
        held |= over
    assert got == pytest.approx({s: 3 * sizes[s] if s in held else weight[s] * left / free for s in order})


def test_mix_of_no_rows_and_of_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], SCHEMA)).collect()
    same([(r.doc_id, r.size, r.taken) for r in got], [(1, 0, 0), (2, 0, 0)])


def _vectors():
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(400, None), (450, []), (500, [float("nan")] * 8), (550, [None] * 8), (600, [1.0, 2.0]), (650, [3.0, 4.0]), (None, rows[3][1])]
    return rows


@pytest.mark.parametrize(("tile", "query_tile", "fan_in"), [(4096, 512, 64), (7, 3, 2)])
def test_top_k(spark, monkeypatch, tile, query_tile, fan_in):
    for name, value in (("TILE", tile), ("QUERY_TILE", query_tile), ("FAN_IN", fan_in)):
        monkeypatch.setattr(topk, name, value)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).repartition(3)
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, k=5).collect()
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = []
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    same(got, expected)


def test_top_k_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def thue_morse(n: int) -> tuple[str, str]:
    """Two different texts of equal value under every polynomial modulo a power of two, if long enough."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_texts_have_hashes_of_their_own(spark, n):
    from boxstats.llm import quality
    from boxstats.llm.text import Rolling, utf8
    from boxstats.llm.tokens import WordIds, tokenizer_path
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    data, offsets = utf8(pa.array([a, b]))
    one, two = Rolling(data).spans(offsets[:-1], offsets[1:])
    assert one != two
    path = tokenizer_path("word_bpe_49k.json")
    ids, cut = WordIds(path).encode(pa.array([a, b]))
    for i, found in enumerate(Tokenizer.from_file(path).encode_batch([a, b], add_special_tokens=False)):
        assert list(ids[cut[i] : cut[i + 1]]) == found.ids
    counts = quality.counts(*utf8(pa.array([f"{a}\n{b}\n{a}"])))
    assert int(np.asarray(counts["n_dup_lines"])[0]) == 1
    rows = [(1, f"{a} x y z w"), (2, f"{b} x y z w"), (3, f"{a} x y z w")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_hashes_of_ranges_beyond_one_block(monkeypatch):
    from boxstats.llm.text import Rolling

    monkeypatch.setattr(Rolling, "BLOCK", 7)
    data = np.frombuffer(b"abcabcabcab" * 9 + bytes(range(256)), np.uint8)
    starts = np.arange(len(data) - 3)
    found = Rolling(data).spans(starts, starts + 3)
    kinds = {}
    for s, h in zip(starts, found):
        assert kinds.setdefault(bytes(data[s : s + 3]), h) == h
    assert len(set(kinds.values())) == len(kinds)


def test_repeated_queries_have_lists_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk.top_k(df.filter("vec_id = 50"), df, k=3).collect()
    first, second = [(1, 1), (2, 2), (3, 2)], [(1, 3), (2, 2), (3, 2)]
    assert sorted((r["rank"], r.vec_id) for r in got) == sorted(first * 2 + second)


@pytest.mark.parametrize("scale", [1.0, 256.0, 2.0**16, 2.0**20])
def test_tiles_meet_in_a_grid_without_broadcast(spark, monkeypatch, scale):
    for name, value in (("TILE", 16), ("QUERY_TILE", 5), ("DATA_BYTES", 1500), ("QUERY_BYTES", 400), ("CELLS_PER_CORE", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (400, 8)), 1)
    x[::7] *= 100
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = topk.top_k(df.filter("vec_id % 4 = 0"), df, k=5, scale=scale)
    got = found.collect()
    # The copies of the queries, one for every group of data, were held by the driver.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    whole = np.floor(scale * x).astype(np.int64)
    expected = []
    for i in range(0, 400, 4):
        scored = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:5]
        expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    same(got, expected)


def test_texts_of_rows_without_doc_id_keep_what_is_theirs(spark):
    rng = random.Random(3)
    shared = prose(rng, 120)
    rows = [(None, f"one {shared} end"), (None, f"two other {prose(rng, 90)}"), (7, f"x {shared} y"), (7, f"z {prose(rng, 90)}"), (7, f"x {shared} y")]
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), _repeated(rows, 200))
