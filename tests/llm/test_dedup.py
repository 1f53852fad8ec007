"""Line, exact, near and substring dedup against brute force, with nulls, ties, empties and long texts."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from kmerloom.llm import chunk_dedup, common, content_dedup, line_dedup, occurrences, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, line string, pos int, h1 bigint, fp string"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def words(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """(doc_id, text) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", 1, 2, "y") for d, t in rows], SCHEMA)


def line_cases():
    shared = [f"  Common LINE number {i} with ÄÖ words\t" for i in range(4)]
    rows = []
    for d in range(40):
        body = [words(6) for _ in range(rng.randint(0, 4))] + rng.sample(shared, rng.randint(0, 3)) + ["short", ""]
        rng.shuffle(body)
        rows.append((d, "\n".join(body)))
    rows += [(40, None), (41, ""), (42, shared[0] + "\n" + shared[0]), (43, "x\n" * 3000 + shared[1].upper()), (44, "\n")]
    return rows + [rows[3]]


def line_truth(rows, min_docs=3):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("all_hot", [False, True])
def test_lines(spark, monkeypatch, all_hot):
    if all_hot:  # every key takes the path of the hot ones
        monkeypatch.setattr(occurrences, "hot_keys", lambda df, keys: df.select(*keys).distinct())
    rows = line_cases()
    docs = table(spark, rows)
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == line_truth(rows)
    assert got.columns[: len(docs.columns)] == docs.columns


def test_lines_null_id_and_empty_table(spark):
    line = "a line of more than twenty letters"
    docs = table(spark, [(None, line), (1, line), (2, line)])
    got = {r.doc_id: r.kept_text for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert got == {None: "", 1: "", 2: line}
    none = docs.limit(0)
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hot", [False, True])
def test_exact(spark, monkeypatch, keep, hot):
    if hot:
        monkeypatch.setattr(content_dedup, "hot_keys", lambda df, keys, share: df.select(*keys).distinct())
    texts = ["a", "", None, "long " * 50_000, "long " * 50_000 + "x", "Ä b", "ä b", "a "]
    rows = [(i, rng.choice(texts)) for i in range(120)] + [(5, "a"), (5, "a"), (None, "a"), (None, "only null id")]
    got = content_dedup.exact_dedup(table(spark, rows), keep).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = []
    for d, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        best = (max(known) if keep == "largest" else min(known)) if known else None
        want.append((d, best, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    show = lambda x: sorted(map(repr, x))
    assert show((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == show(want)
    assert sum(r.kept for r in got) == len(groups)
    assert content_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def test_exact_spreads_repeated_ids(spark):
    """Copies of one text without an identifier are dealt over salts by the part of the input they stand in; one of them stays."""
    same = spark.createDataFrame([(None, "copy"), (7, "copy"), (7, "copy")] * 2000, "doc_id bigint, text string").repartition(16)
    for keep in ("largest", "smallest"):
        got = content_dedup.exact_dedup(same, keep)
        assert got.filter("kept").count() == 1
        assert [tuple(r) for r in got.groupBy("keep_id", "group_size").count().collect()] == [(7, 6000, 6000)]
    none = content_dedup.exact_dedup(same.withColumn("doc_id", F.lit(None).cast("bigint")))
    assert none.filter("kept").count() == 1 and {tuple(r) for r in none.select("keep_id", "group_size").collect()} == {(None, 6000)}


def test_columns_of_any_name(spark):
    """Names that the operators use inside, and names with dots, are other columns like all."""
    names = ["_doc", "_fp", "_s_out", "_s_spans", "_s_doc", "_b_drops", "_b_doc", "_rest", "c0", "a.b", "places", "drops"]
    line = "a line of more than twenty letters"
    docs = spark.createDataFrame([(i, line, *range(len(names))) for i in range(4)], ["doc_id", "text", *names])
    lined = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert lined.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    cut = chunk_dedup.dedup_substrings(docs)
    assert cut.columns == [*docs.columns, "n_spans", "n_bytes_dropped"]
    for rows in (lined.collect(), cut.collect()):
        assert all(tuple(r)[2 : 2 + len(names)] == tuple(range(len(names))) for r in rows)


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    order = sorted(fps)
    values = np.array([fps[d] for d in order], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= radius
    label = np.arange(len(order))
    while True:
        new = np.where(near, label[None], len(order)).min(1)
        if (new == label).all():
            return {d: order[x] for d, x in zip(order, label, strict=True)}
        label = new


def test_simhash(spark):
    rows, base = [], [words(120) for _ in range(12)]
    for d in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((d, " ".join(w)))
    rows += [(150, None), (151, " \t\n"), (152, "One"), (153, "one two"), (154, "ONE two"), (155, "Ünïcode wörds here ok"), (156, words(30_000)), (157, "a\xa0b\x1cc")]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(table(spark, rows)).collect()}
    fps = {d: slow_fingerprint(t) for d, t in rows}
    assert got == {d: (fps[d], c) for d, c in components(fps, 2).items()}
    again = table(spark, [*rows[:3], rows[0]])
    assert simhash.simhash_components(again).count() == 4
    assert simhash.simhash_components(again.limit(0)).count() == 0


@pytest.mark.parametrize(("crowded", "together"), [(4096, 1024), (50, 40), (1, 1)])
def test_links_of_random_nodes(spark, monkeypatch, crowded, together):
    """Close fingerprints in all places of the word, and one large bucket, dealt once and twice."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(rng.randint(0, 6)):
            s ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(s)
    fps |= {(seeds[0] >> 32 << 32) | rng.getrandbits(13) for _ in range(3000)}
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), 2).collect()
    label = np.arange(len(fps))
    place = {x[0]: i for i, x in enumerate(signed)}
    simhash._hook(label, np.array([place[r.u] for r in found]), np.array([place[r.v] for r in found]))
    want = components({i: x for i, x in enumerate(fps)}, 2)
    groups = lambda pairs: {frozenset(v) for v in _by(pairs).values()}
    assert groups(enumerate(label)) == groups(want.items())
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed[:2], "fp bigint"), 3)


def _by(pairs):
    out = defaultdict(set)
    for k, v in pairs:
        out[v].add(k)
    return out


def test_join_with_hot(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(i, i) for i in range(2, 50)], "k int, v int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    assert common.join_with_hot(left, right, ["k"], "n", 348).count() == 348


def test_cuts_follow_content():
    data = words(3000).encode()
    ends = chunk_dedup.cuts(data)
    assert ends[-1] == len(data) and (np.diff(np.append(0, ends))[:-1] >= chunk_dedup.LEAST).all() and np.diff(np.append(0, ends)).max() <= chunk_dedup.MOST
    moved = chunk_dedup.cuts(data[:500] + b"inserted" + data[500:])
    assert len(set(ends[ends > 900]) - {x - 8 for x in moved}) == 0
    assert chunk_dedup.cuts(b"").size == 0 and chunk_dedup.cuts(b"a" * 1000)[-1] == 1000
    h, hashes = 0, []
    for b in data[:430]:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFF
        hashes.append(h)
    w = chunk_dedup.AROUND
    fit = {i + 1 for i, h in enumerate(hashes) if h >> (16 - chunk_dedup.BITS) == 0 or i >= w and h == min(hashes[i - w : i + w + 1])}
    assert set(ends[ends <= 390].tolist()) <= fit


def common_words(a, b, least):
    """Whether two texts share a piece of ``least`` words."""
    w, known = a.split(), b.split()
    have = {tuple(known[i : i + least]) for i in range(len(known) - least + 1)}
    return any(tuple(w[i : i + least]) in have for i in range(len(w) - least + 1))


def test_stitched_documents_stay(spark):
    """Short passages of many documents side by side are no repeat of one document; a long one of one document is."""
    own = [words(60) for _ in range(40)]
    stitched = " ".join(" ".join(t.split()[20:38]) for t in own)
    twice = " ".join(own[7].split()[5:35]) + " " + words(10) + " " + " ".join(own[8].split()[5:35])
    rows = [(i, t) for i, t in enumerate(own)] + [(100, stitched), (101, twice)]
    got = {r.doc_id: r for r in chunk_dedup.dedup_substrings(table(spark, rows), min_words=25).collect()}
    assert got[100].text == stitched and got[100].n_spans == 0
    assert got[101].n_spans == 2 and len(got[101].text.split()) <= 14


def test_every_cut_is_a_repeat_of_one_document(spark):
    pool = [words(rng.choice([10, 30, 70])) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else words(rng.randint(5, 60)) for _ in range(6))) for i in range(60)]
    got = {r.doc_id: r for r in chunk_dedup.dedup_substrings(table(spark, rows), min_words=25).collect()}
    spans = {r.doc: [x.asDict(recursive=True) for x in r.spans] for r in chunk_dedup.passages(table(spark, rows), 24).collect()}
    cut = missed = 0
    for d, t in rows:
        data = t.encode()
        found = chunk_dedup.widen(data, spans.get(d, []), 25)
        assert got[d].text == chunk_dedup.cut_out(data, found)[0]
        for x in spans.get(d, []):
            for a, b in chunk_dedup.widen(data, [x], 25):
                assert any(data[a:b].decode() in other for e, other in rows if e < d)
                cut += 1
        missed += any(common_words(got[d].text, other, 40) for e, other in rows if e < d)
    assert cut > 20 and missed <= 2


def test_substrings(spark):
    passages = [words(60) for _ in range(4)]
    rows = []
    for d in range(30):
        parts = [words(80), words(50)]
        if d % 3 == 0:
            parts.insert(1, passages[d % 4])
        rows.append((d, "\n".join(parts)))
    copy = rows[1][1]
    rows += [(30, None), (31, ""), (32, copy), (33, "ß" * 5000), (34, words(20_000)), (None, "tiny")]
    out = chunk_dedup.dedup_substrings(table(spark, rows)).collect()
    got = {r.doc_id: r.text for r in out}
    first = set()
    for d, t in rows[:30]:
        if d % 3 == 0 and d % 4 in first:
            inside = passages[d % 4].split()
            gone = len(t.split()) - len(got[d].split())
            assert len(inside) <= gone <= len(inside) + 3  # words beside a passage may be the same by chance
            for part in t.split("\n")[::2]:
                assert part.split()[1] in got[d]
        else:
            assert got[d] == t
        if d % 3 == 0:
            first.add(d % 4)
    assert got[32].strip() == "" or len(got[32].split()) < 20
    assert [got[30], got[31], got[33], got[34], got[None]] == [None, "", rows[33][1], rows[34][1], "tiny"]
    assert [c for c in table(spark, rows).columns] == list(out[0].asDict())[:9]
    assert chunk_dedup.dedup_substrings(table(spark, rows).limit(0)).count() == 0
