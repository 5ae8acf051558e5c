"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, letters: str = "abcdeé") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """Texts with shared passages and copies, then nulls, empties, a long text and repeated rows."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(5, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(["", " ", "\n"]) + rng.choice(passages) + " " + prose(rng, rng.randint(0, 30))
        rows.append((i, text, "en", rng.choice(["s1", "s2", "s3"]), len(text)))
    rows += [
        (1000, None, "en", "s1", None), (1001, "", "de", "s2", 0), (1002, " \n\t ", None, None, 4),
        (1003, prose(rng, 9000), "en", "s1", None), (1004, rows[3][1], "fr", "s3", 1), (1005, "a" * 700, None, "s1", 700),
        (None, rows[5][1], "en", "s1", None), rows[7], rows[7], (1006, "x", "de", None, 1), (1007, "日本語 ßß İ \x1c \x85", "xx", "s2", 3),
    ]
    return rows


def frame(spark, rows, clash: bool = False):
    """The rows as a DataFrame; ``clash`` adds columns named like those that operators make."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if clash:
        for name in ("size", "rep", "length", "low", "hk", "bands", "score", "target", "kept", "piece", "rest", "body", "_h"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def same(got, expected) -> None:
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)
