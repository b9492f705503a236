"""Small documents with every awkward case, shared by the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, k long, words int"


def prose(r: random.Random, n: int) -> str:
    made = [a + b for a in "ba de ki lo mu ra se ti vo the and of".split() for b in ("", "n", "rs", "ting", "é")]
    return " ".join(r.choice(made) for _ in range(n))


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    shared = prose(r, 70)
    rows: list[list] = []
    for i in range(n):
        text = prose(r, r.choice([1, 3, 4, 5, 6, 30, 80, 200]))
        if i % 7 == 0:
            text = text + "\n" + shared + ".\n" + text[:40]
        if i % 9 == 0 and rows:
            text = rows[r.randrange(len(rows))][1]
        if i % 11 == 0 and rows:
            words = (rows[r.randrange(len(rows))][1] or "x").split()
            words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
            text = " ".join(words)
        rows.append([i * 3 - 20, text])
    rows += [[1000, None], [1001, ""], [1002, " \n\t "], [1003, "\n".join(["same line here"] * 40)], [1004, "a" * 5000], [1005, "x y " * 4000]]
    rows += [[1006, "long " + prose(r, 60_000)], [1007, "Ünïcödé 漢字 🎉 \x00 \x1c text ###$$$"], [1008, "<|endoftext|> it's 're"], [1009, shared.upper()]]
    rows += [[1006, rows[-4][1]]]  # a row again
    return [(k, t, r.choice(["en", "fr", "de", None]), r.choice(["s", None]), None if t is None else len(t), "x", i, 1) for i, (k, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
