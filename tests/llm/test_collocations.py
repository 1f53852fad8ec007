"""Operator 13 against a count of phrases one by one."""

import random
import re
from collections import Counter

from kmerloom.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(docs, least, longest=3, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in often.items():
        lang, words = p[0], p[1:]
        over = [b for q, b in often.items() if q[0] == lang and len(q) > len(p) and any(q[1 + i : 1 + i + len(words)] == words for i in range(len(q) - len(words)))]
        if any(100 * b >= 50 * a for b in over):
            continue
        score, _, left, right = min((10**6 * a * a // (f[p[: 1 + k]] * f[(lang, *words[k:])]), k, f[p[: 1 + k]], f[(lang, *words[k:])]) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def documents(rng, n=80):
    words = ["a", "A", "b", "é", "漢字", "ca", "d d"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", ";\r"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None, "und"]), None if rng.random() < 0.1 else text()) for _ in range(n)]


def test_equals_counts_one_by_one(spark):
    rng = random.Random(3)
    docs = documents(rng)
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert rows_of(C.collocations(frame, least=4)) == sorted(model(docs, 4))
    assert rows_of(C.collocations(frame, least=3, top=5)) == sorted(model(docs, 3, top=5))
    # shards and blocks that cut texts and pieces anywhere, and a set whose slots are shared by many
    assert rows_of(C.collocations(frame, least=4, shard=7, block=3, slots=64)) == sorted(model(docs, 4))
    assert rows_of(C.collocations(frame, least=4, longest=4)) == sorted(model(docs, 4, 4))


def test_numbers_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a", 3_000_000_000_000, 1), ("en", "b", 2_000_000_000_000, 1), ("en", "a b", 1_900_000_000_001, 2)], "lang string, phrase string, n bigint, words int")
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, total bigint")
    row = C._scored(found, totals, 2).first()
    assert row["score"] == 10**6 * 1_900_000_000_001**2 // (3_000_000_000_000 * 2_000_000_000_000)


def test_cases(spark):
    schema = "lang string, text string, a int, phrase int, n int, words int"
    docs = [(None, "x y", 1, 1, 1, 1), ("und", "x y", 1, 1, 1, 1), ("en", None, 1, 1, 1, 1), ("en", "", 1, 1, 1, 1), ("en", "z. " * 20, 1, 1, 1, 1), ("de", "q " * 50_000, 1, 1, 1, 1)]
    frame = spark.createDataFrame(docs, schema)
    got = rows_of(C.collocations(frame, least=2, shard=1000))
    assert got == sorted(model([d[:2] for d in docs], 2))
    assert [r[:3] for r in got] == [("de", 1, "q q q"), ("und", 1, "x y")]
    assert C.collocations(frame.limit(0)).count() == 0
