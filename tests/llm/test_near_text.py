"""Near-dedup stage of the pipeline: shingle similarity, equal and null ids."""

import random

import corpus_pipeline
from kmerloom.llm import near_text, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)


def similarity(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5, 42).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_beyond_two_bits(spark, monkeypatch):
    monkeypatch.setattr(near_text, "TILE", 2)
    rng, rows, want = random.Random(3), [], []
    for k in range(30):
        base = words(rng, 200)
        near, far = list(base), list(base)
        for at in (20, 90, 150):
            near[at] = "changed"
        for at in range(10, 190, 15):
            far[at] = "changed"
        assert similarity(" ".join(base), " ".join(near)) >= 0.8 > 0.7 > similarity(" ".join(base), " ".join(far))
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        want += [rows[-3], rows[-1]]
    assert stage(spark, rows) == sorted(want, key=str)


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_text, "TILE", 3)
    rng = random.Random(5)
    base, rows = words(rng, 150), []
    for i in range(40):  # edits of one text: most pairs share a band, some are near
        text = list(base)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            text[at] = f"w{rng.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    root = list(range(40))
    for a in range(40):
        for b in range(a):
            if similarity(rows[a][1], rows[b][1]) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert [i for i, _ in stage(spark, rows)] == sorted(set(root), key=lambda i: str(rows[i]))


def test_rows_with_equal_or_null_id_stay(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, c), (7, c), (7, d), (7, d), (8, d), (None, None), (9, "")]
    assert stage(spark, rows) == sorted([(None, a), (None, b), (7, c), (7, d), (9, "")], key=str)
    assert stage(spark, rows[:0]) == []


def test_links_of_operator_9(spark, monkeypatch):
    """Operator 9's own pass alone, without any band, joins fingerprints within two bits; before, the stage had no such pass."""
    rng = random.Random(6)
    base = words(rng, 3000)
    near = list(base)
    near[1500] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(words(rng, 3000)))]
    a, b, c = (simhash.fold(near_text.np.unique(simhash.shingle_hashes(t, 5, 42))) for _, t in rows)
    assert 0 < (a ^ b).bit_count() <= 2 < (a ^ c).bit_count()
    number = iter(range(10**6))
    monkeypatch.setattr(near_text, "band_keys", lambda found: near_text.np.full(near_text.BANDS, int(found.min()) >> 1, near_text.np.uint64) + near_text.np.uint64(next(number)))
    assert [i for i, _ in stage(spark, rows)] == [1, 3]
