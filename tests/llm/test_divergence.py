"""Operator 11 against sums over all terms one by one."""

import random
import re
from collections import Counter, defaultdict

from kmerloom.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def model(docs, least, top):
    groups, seen, n = defaultdict(set), Counter(), Counter()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in docs):
        groups[lang].add(source)
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        seen.update({(lang, t) for t in terms})
        n.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), c in seen.items() if x == lang and c >= least)
        v, total = len(kept), {s: sum(n[lang, s, t] for t in kept) for s in sources}

        def p(count, all_, v=v):
            return 1 + 10**9 * (count + 5) // (all_ + 5 * v)

        for s in sources:
            pairs = [(sum(abs(p(n[lang, s, t], total[s]) - p(n[lang, o, t], total[o])) for t in kept), o) for o in sources if o != s]
            terms = [(p(n[lang, s, t], total[s]) - p(sum(n[lang, o, t] for o in sources), sum(total.values())), t) for t in kept if n[lang, s, t]]
            for part, rows in (("pair", pairs), ("term", [r for r in terms if r[0] > 0])):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(rows, 1) if part == "pair" or rank <= top]
    return sorted(out)


def documents(rng, n=200, sources=9):
    words = ["a", "B", "É", "ç1d", "zz", "don't", "漢", *(f"w{c}" for c in "abcdefghijklm")]
    one = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    rows = [(None if rng.random() < 0.05 else one(), rng.choice(["en", "en", "de", None]), rng.choice([None, *(f"s{i}" for i in range(sources))])) for _ in range(n)]
    return [*rows, (None, "fr", "x"), ("12 3", "fr", "y"), ("rare", "fr", "z"), ("b", "it", "alone")]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_sums_one_by_one(spark):
    docs = documents(random.Random(2))
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    assert rows_of(D.divergence(frame, 5, 4)) == model(docs, 5, 4)


def test_tiles_and_parts(spark):
    """Sources in tiles of two and vectors in parts of five give the same sums."""
    docs = documents(random.Random(4), 120, 5)
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    assert rows_of(D.divergence(frame, 3, 50, tile=2, part=5)) == model(docs, 3, 50)


def test_large_numbers():
    import numpy as np

    count, total = np.array([5, 8_000_000_000_000_001, 7]), np.array([8_999_999_999_999_999] * 3)
    assert D.smoothed(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_cases(spark):
    frame = spark.createDataFrame([(None, None, None, 1, 2)], "text string, lang string, source string, s int, term int")
    assert rows_of(D.divergence(frame)) == []
    assert D.divergence(frame.limit(0)).count() == 0
    two = spark.createDataFrame([("a " * 100_000, "en", "x"), ("", "en", "y"), ("a", "en", "x")], "text string, lang string, source string")
    assert rows_of(D.divergence(two, 2)) == model([("a " * 100_000, "en", "x"), ("", "en", "y"), ("a", "en", "x")], 2, 50)


def broadcast(df):
    """Lines of a plan that broadcast a table."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line]


def test_vectors_stay_out_of_the_driver(spark, monkeypatch):
    """No table of vectors or terms is broadcast, whatever its files' size; with many groups nothing is."""
    docs = documents(random.Random(6), 150, 5)
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    values = D.Audit(frame, 3).term_values(50)
    assert len(broadcast(values)) == 2
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
    assert not broadcast(D.Audit(frame, 3).term_values(50))
    assert rows_of(D.divergence(frame, 3, 50, tile=2, part=5)) == model(docs, 3, 50)
