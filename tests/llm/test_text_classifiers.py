import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boxstats.llm import language, quality, toxicity
from tests.llm.data import SCHEMA, WORD, documents, frame, prose, same


def _counts(text):
    text = text or ""
    words, seen, dup, windows, covered = WORD.findall(text), set(), 0, defaultdict(list), set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    for places in windows.values():
        if len(places) > 1:
            covered |= {p + j for p in places for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def _labelled(spark, rng, bad, label):
    rows = []
    for i in range(160):
        text = prose(rng, 120, "abcdefgh")
        rows.append((i, bad(text, i) if i % 2 else text, "en", "s", 1))
    labels = spark.createDataFrame([(r[0], 1 - r[0] % 2, r[0] % 2) for r in rows] + [(None, 1, 1), (10**6, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return frame(spark, rows), labels


def test_quality_counts(spark):
    rows = [*documents(), (3000, "x\nx\nx | y #", "en", "s", 1), (3001, "a b c a b c\n\nq", "en", "s", 1), (3002, "\n\n", "en", "s", 1)]
    got = quality.score(frame(spark, rows, clash=True), None).collect()
    same([tuple(r)[:6] for r in got], [(r[0], *_counts(r[1])) for r in rows])
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_quality_learns_and_keeps_columns(spark):
    docs, labels = _labelled(spark, random.Random(1), lambda t, i: t.upper().replace(" ", "%% "), "quality")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert sum(r.kept == (r.doc_id % 2 == 0) for r in got) >= 155
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(frame(spark, documents()), none) is None
    assert toxicity.fit(frame(spark, documents()), none) is None
    assert quality.score(spark.createDataFrame([], SCHEMA), None).count() == 0
    assert toxicity.score(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_toxicity_sees_misspelt_words(spark):
    rng = random.Random(2)
    worst = ("zzlurpk", "zlurpk", "zzlurpy", "zzzlurpk")
    docs, labels = _labelled(spark, rng, lambda t, i: t + " " + " ".join(rng.choice(worst) for _ in range(4)), "toxic")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 < 2)
    got = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id % 4 >= 2) >= 76
    odd = {r.doc_id: r.score for r in toxicity.score(frame(spark, [(1, prose(rng, 80, "abcdefgh") + " zzlurpkin zlurpky zzlurpi", "", "", 1), *documents()], clash=True), model).collect()}
    assert odd[1] >= 0.5 and 1000 in odd and 1001 in odd


def test_toxicity_features_stay_inside_words():
    n, parts = toxicity.features(pa.array(["Ab, c!", None, "é", "ab"]))
    per_row = [sum(int((r == i).sum()) for _, r in parts) for i in range(n)]
    # <ab>: 3 + 3, 4 and the word; <c>: 3 and the word; <é> has four bytes.
    assert per_row == [4 + 2, 0, 4, 4]


def _bundle(text, letters):
    symbols = [0]
    for c in (text or "").lower() + "\t":
        s = (ord(c) if ord(c) < 256 else 256 + ord(c) % language.OTHERS) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    out = np.zeros(letters.shape[2])
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        out += letters[0][a] * letters[1][b] * letters[2][c]
    return out


def test_bundles_are_sums_of_bound_letters():
    letters = language._letters(64)
    texts = [r[1] for r in documents()] + ["", "a", "1 2", " x y ", None]
    body, has = language.bundles(pa.array(texts), letters)
    assert np.allclose(body, [_bundle(t, letters) for t in texts], atol=1e-3)
    assert has.tolist() == [any(c.isalpha() for c in t or "") for t in texts]


def test_language_on_texts_not_seen(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60, "abcdé" if i % 2 else "vwxyü"), "l1" if i % 2 else "l2", "s", 1) for i in range(80)]
    docs = frame(spark, rows)
    names, vectors = language.prototypes(docs.filter("doc_id < 40"))
    got = language.predict(docs, names, vectors).collect()
    assert names == ["l1", "l2"]
    assert all(r.lang_pred == ("l1" if r.doc_id % 2 else "l2") and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language.predict(frame(spark, documents(), clash=True), names, vectors).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1000, 1001, 1002))


def test_language_learns_from_every_labelled_text(spark):
    # 30,000 texts of one language, and twelve languages of one text each.
    rare = ["".join(chr(0x61 + (7 * i + 5 * j * j) % 26) + " "[: j % 3 == 2] for j in range(40)) for i in range(12)]
    rows = [(i, "abc cab bca", "common", "s", 1) for i in range(30_000)] + [(10**6 + i, t, f"r{i:02}", "s", 1) for i, t in enumerate(rare)]
    rows += [(2 * 10**6, "12 34", "no letter", "s", 1), (2 * 10**6 + 1, None, "no text", "s", 1), (None, "xyz", "r00", "s", 1)]
    docs = frame(spark, rows)
    names, vectors = language.prototypes(docs, dim=256)
    letters = language._letters(256)
    want = {}
    for _, text, lang, *_ in [rows[0], *rows[30_000:]]:
        if text and any(c.isalpha() for c in text):
            body = _bundle(text, letters)
            want[lang] = want.get(lang, 0) + body / np.linalg.norm(body)
    assert names == sorted(want)
    assert np.allclose(vectors, [want[x] / np.linalg.norm(want[x]) for x in names], atol=1e-5)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs.filter("doc_id BETWEEN 1000001 AND 1999999"), names, vectors).collect()}
    assert got == {10**6 + i: f"r{i:02}" for i in range(1, 12)}


def test_language_without_labels(spark):
    names, vectors = language.prototypes(spark.createDataFrame([], SCHEMA))
    assert names == []
    got = language.predict(frame(spark, documents()), names, vectors).collect()
    assert {r.lang_pred for r in got} == {"und"}
