"""Operator 12 against windows looked up one by one."""

import hashlib
import random
import re

from kmerloom.llm.contamination import Automaton, contamination, match_items, remove_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(text, items, window):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(name)
    names = sorted(str(x) for x in found if x is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_case(rng, docs=60, items=12):
    text = lambda n: " ".join(rng.choice("ab aB b. Éa c1 漢".split(" ")) for _ in range(rng.randrange(n)))
    own = [(i, text(14)) for i in range(items)]
    return [(i, None if rng.random() < 0.1 else text(30) + rng.choice(own)[1] + text(9)) for i in range(docs)], [*own, (99, None), (98, ""), (3, own[5][1])]


def test_equals_windows_one_by_one(spark):
    rng = random.Random(5)
    for window, blocks in ((4, 10**6), (6, 10**6), (4, 60)):
        docs, items = random_case(rng)
        found = match_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window, blocks)
        got = {r["doc_id"]: (r["n_words"], sum(s["words"] for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found.collect()}
        assert got == {i: model(t, items, window) for i, t in docs}


def test_automaton_finds_longest_matches():
    rng = random.Random(1)
    for _ in range(200):
        items = [(str(i), [rng.choice("abc") for _ in range(rng.randrange(1, 12))]) for i in range(rng.randrange(1, 6))]
        automaton = Automaton(4).add(items)
        words = [rng.choice("abcd") for _ in range(40)]
        state, length = 0, 0
        for at, w in enumerate(words, 1):
            state, length = automaton.follow(state, length, automaton.vocabulary.get(w, -1))
            fits = lambda n: any(own[i : i + n] == words[at - n : at] for _, own in items for i in range(len(own) - n + 1))  # noqa: E731, B023
            assert length == max(n for n in range(at + 1) if not n or fits(n))


def test_cases(spark):
    docs = [(None, None, 1), (None, "", 2), (1, "one two three", 3), (1, "one two three", 4), (2, "x " * 30000 + "One, Two; three four", 5)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, n_words int")
    items = spark.createDataFrame([(7, "two three"), (None, "one two"), (8, "two THREE"), (9, "?"), (10, None)], "item_id bigint, text string")
    got = rows_of(contamination(frame, items).select("doc_id", "n_words", "n_hit", "n_items", "contaminated"))
    assert got == sorted([(None, 0, 0, 0, False)] * 2 + [(1, 3, 3, 2, True)] * 2 + [(2, 30004, 3, 2, True)], key=str)
    assert contamination(frame.limit(0), items).count() == 0
    assert {r["contaminated"] for r in contamination(frame, items.limit(0)).collect()} == {False}
    named = spark.createDataFrame([("a", "one two three")], "doc_id string, text string")
    assert contamination(named, items).first()["doc_id"] == "a"


def test_remove_spans(spark):
    items = spark.createDataFrame([(1, "b c d e")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "é a B, c d e f g h i j"), (2, "b c d e f"), (3, "clean"), (4, None)], "doc_id bigint, text string")
    got = rows_of(remove_spans(match_items(docs, items, 4), longest=4))
    assert got == [(1, "é a  f g h i j", 1, False), (2, "", 1, True), (3, "clean", 0, False), (4, "", 0, False)]
    assert rows_of(remove_spans(match_items(docs, items, 4), longest=5))[0] == (1, "é a B, c d e f g h i j", 0, False)
