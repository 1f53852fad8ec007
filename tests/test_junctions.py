"""Boundary lists: golden cases, equality of the forms, and extension."""

import random

import numpy as np
import pytest

from kmerloom.functions.codes import code_of
from kmerloom.operators import bloom, junctions as J, kmers, splice
from kmerloom.operators.lookup import canonical_text
from tests.junction_model import boundary_list

rng = random.Random(5)


def bases(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def kset(k, *seqs):
    return {canonical_text(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1)}


def distinct_blocks(k, *sizes):
    """Random blocks whose joins and insertions make no chance k-mer of the set, with different bases at the joins."""
    while True:
        out = [bases(n) for n in sizes]
        if len(kset(k - 4, *out)) == sum(n - k + 5 for n in sizes) and len({s[0] for s in out} | {s[-1] for s in out}) >= 3:
            return out


def scan(seq, k, leniency, known, compat=True):
    return J.scan_record(seq, k, leniency, lambda x: not x.strip("ACGT") and canonical_text(x) in known, compat)[0]


A, B, D = distinct_blocks(12, 30, 30, 30)
while A[-1] == B[0] or A[0] == B[0] or B[-1] == D[0] or A[-1] == D[0] or A[-1] == B[-1]:
    A, B, D = distinct_blocks(12, 30, 30, 30)
AB = kset(10, A, B)


def junction_free(a, b, known, k=10):
    """No k-mer across the join is in the set."""
    s = a + b
    return not any(canonical_text(s[i : i + k]) in known for i in range(len(a) - k + 1, len(a)))


def test_golden_lists():
    assert junction_free(A, B, AB)
    assert scan(A + B, 10, 0, AB) == [1, 30, 30, 58]
    abd = kset(10, A, B, D)
    if junction_free(B, D, abd) and junction_free(A, B, abd):
        for leniency in (0, 3):
            assert scan(A + B + D, 10, leniency, abd)[:2] == [1, 30]
    s = bases(60)
    assert scan(s, 10, 0, kset(10, s)) == [1, 58]
    assert scan(s, 10, 0, kset(10, s[5:40])) == [6, 40]
    assert scan("ACGTACGTACGTAC", 10, 0, AB) == []
    assert scan(bases(40), 10, 0, set()) == []


def test_novel_bases():
    for n, leniency, want in ((5, 0, [1, 30, 35, 63]), (7, 0, [1, 30, 31, 65]), (7, 3, [1, 30, 31, 36, 37, 65])):
        for _ in range(40):
            novel = bases(n)
            s = A + novel + B
            across = [canonical_text(s[i : i + 10]) in AB for i in range(21, 30 + n)]
            if not any(across) and novel[0] != B[0] and novel[-1] != A[-1]:
                got = scan(s, 10, leniency, AB)
                assert got == want
                break


@pytest.mark.parametrize(("k", "leniency"), [(10, 3), (50, 10)])
def test_substitution(k, leniency):
    genome = bases(400)
    known = kset(k, genome)
    for at in range(100, 130):
        true = genome[at]
        wrong = next(b for b in "ACGT" if b != true)
        seq = genome[:at] + wrong + genome[at + 1 :]
        if any(canonical_text(seq[i : i + k]) in known for i in range(at - k + 1, at + 1)):
            continue
        has = lambda x: canonical_text(x) in known
        bounds, fixes = J.scan_record(seq, k, leniency, has, True)
        if true == "C":
            assert fixes == []
            assert len(bounds) >= 2
            assert J.scan_record(seq, k, leniency, has, False)[1] == [(at, wrong, true)]
        else:
            assert (bounds, fixes) == ([1, 398], [(at, wrong, true)])
        assert len(J.scan_record(seq, k, 0, has, True)[0]) == 4


def _frames(spark, n=24, k=10):
    seqs, blocks = [], [bases(40) for _ in range(12)]
    for i in range(n):
        parts = rng.sample(blocks, rng.randint(1, 4))
        s = bases(rng.choice([0, 3, 7])).join(parts)
        s = "".join(rng.choice("ACGTN") if rng.random() < 0.01 else c for c in s)
        seqs.append((f"t{i}", s))
    seqs += [("short", "ACGT"), ("none", "N" * 40)]
    refs = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "id int, seq string")
    return spark.createDataFrame(seqs, "id string, seq string"), kmers.reference_set(refs, k), kset(k, *blocks)


def test_windows_equal_state_machine(spark):
    seqs, known, table = _frames(spark)
    got = {r.id: r.bounds for r in J.boundaries_by_windows(seqs, known, 10, 0).collect()}
    has = lambda x: not x.strip("ACGT") and canonical_text(x) in table
    want = {r.id: boundary_list(r.seq, 10, 0, has)[0] for r in seqs.collect()}
    assert got == {i: b for i, b in want.items() if b}


def test_rounds_equal_broadcast(spark):
    seqs, known, table = _frames(spark, n=10)
    one = {r.id: (r.bounds, r.fixes) for r in J.boundaries(seqs, known, 10, 3).collect()}
    many = {r.id: (r.bounds, r.fixes) for r in J.boundaries(seqs, known, 10, 3, limit=0).collect()}
    assert one == many
    has = lambda x: not x.strip("ACGT") and canonical_text(x) in table
    assert {i: b for i, (b, _) in one.items()} == {r.id: b for r in seqs.collect() if (b := boundary_list(r.seq, 10, 3, has)[0])}


def test_cutting(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGTACGTACGTACGTACGTACGTAC"), ("b", "ACGTACGTAC")], "id string, seq string")
    bounds = spark.createDataFrame([("a", [1, 10, 8, 20, 21, 28]), ("b", [2, 6])], "id string, bounds array<int>")
    got = [(r.id, r.start, r.end, len(r.exon_seq)) for r in J.all_exons(seqs, bounds).orderBy("id", "exon_no").collect()]
    assert got == [("a", 1, 8, 8), ("a", 10, 20, 11), ("a", 21, 28, 8), ("b", 2, 6, 5)]
    inner = [(r.id, r.start, r.end) for r in J.confident_exons(seqs, bounds).orderBy("id", "exon_no").collect()]
    assert inner == [("a", 8, 20), ("b", 2, 6)]


def walk(seq, k, left, has):
    """Row-at-a-time model of one greedy walk."""
    kmer, out = (seq[:k], "") if left else (seq[-k:], "")
    for _ in range(splice.STEPS):
        base = next((b for b in splice.WALK_ORDER if has((b + kmer)[:k] if left else (kmer + b)[-k:])), None)
        if base is None:
            break
        kmer, out = ((base + kmer)[:k], base + out) if left else ((kmer + base)[-k:], out + base)
    return out


def extended(seq, k, left, right, has):
    if len(seq) < k:
        return seq
    found = walk(seq, k, True, has)
    for y in range(len(found), 1, -1):
        if found[y - 2 : y] in left:
            seq = found[y:] + seq
            break
    found = walk(seq, k, False, has)
    for y in range(len(found) - 1):
        if found[y : y + 2] in right:
            return seq + found[:y]
    return seq


def test_extension(spark):
    genome = bases(3000)
    cuts = [(i, genome[i * 60 : i * 60 + rng.choice([5, 20, 30, 45])]) for i in range(50)] + [(50, "ACGTNACGTNNACG"), (51, bases(40)), (52, "")]
    seqs = spark.createDataFrame(cuts, "id int, seq string")
    for k in (8, 12):
        known = kset(k, genome)
        table = kmers.reference_set(spark.createDataFrame([(genome,)], "seq string"), k)
        has = lambda x: not x.strip("ACGT") and canonical_text(x) in known
        for left, right in ((["AG", "TG", "AC", "GC", "GG"], ["GT", "TT", "AT"]), (["CC"], []), ([], ["CC"])):
            got = {r.id: r.extended_seq for r in splice.extend_exons(seqs, table, k, left, right).collect()}
            assert got == {i: extended(s, k, left, right, has) for i, s in cuts}
    assert splice.extend_exons(seqs.limit(0), table, 12, ["AG"], ["GT"]).count() == 0
    found = {r.id: r.right for r in splice.walks(seqs, table, 12, compat=True).collect()}
    assert all(r == "" or set(r) == {"A"} for r in found.values()) and any(found.values())


def random_record(own):
    """(seq, k, leniency, set): blocks of a reference in any order, cut, with novel bases between and some bases changed."""
    rb = lambda n: "".join(own.choice("ACGT") for _ in range(n))
    k = own.choice([6, 7, 8, 10])
    refs = [rb(own.randrange(k, 40)) for _ in range(own.randrange(1, 5))]
    parts = []
    for _ in range(own.randrange(1, 7)):
        block = own.choice(refs)
        parts += [block[own.randrange(len(block)) :] if own.random() < 0.5 else block, rb(own.randrange(2 * k)) if own.random() < 0.3 else ""]
    seq = "".join(own.choice("ACGTN") if own.random() < 0.03 else c for c in "".join(parts))
    return seq, k, own.randrange(k - 1), kset(k, *refs)


@pytest.mark.parametrize("compat", [True, False])
def test_scan_equals_model(compat):
    """10,000 random records, both readings of the quirk, against a model that shares no code."""
    own = random.Random(11)
    fixed = 0
    for _ in range(10_000):
        seq, k, leniency, known = random_record(own)
        has = lambda x: not x.strip("ACGT") and canonical_text(x) in known  # noqa: E731, B023
        bounds, fixes = J.scan_record(seq, k, leniency, has, compat)
        assert (bounds, fixes) == boundary_list(seq, k, leniency, has, compat)
        fixed += len(fixes)
    assert fixed > 1000


@pytest.mark.parametrize("compat", [True, False])
def test_frontier_equals_model(spark, compat):
    """Random records of many gaps, all gaps at once, against the model; some need more bases, some enter a run in its middle."""
    own = random.Random(12)
    for k, leniency, count in ((6, 4, 700), (8, 5, 700), (10, 2, 400)):
        rb = lambda n: "".join(own.choice("ACGT") for _ in range(n))
        refs = [rb(own.randrange(k, 60)) for _ in range(12)]
        known, rows = kset(k, *refs), []
        for i in range(count):
            parts = []
            for _ in range(own.randrange(1, 12)):
                block = own.choice(refs)
                parts += [block[own.randrange(len(block)) :] if own.random() < 0.5 else block, rb(own.randrange(2 * k)) if own.random() < 0.3 else ""]
            rows.append((f"r{i}", "".join(own.choice("ACGTN") if own.random() < 0.03 else c for c in "".join(parts))))
        has = lambda x: not x.strip("ACGT") and canonical_text(x) in known  # noqa: E731, B023
        want = {i: (b, f) for i, s in rows for b, f in [boundary_list(s, k, leniency, has, compat)] if b}
        table = kmers.reference_set(spark.createDataFrame([(r,) for r in refs], "seq string"), k)
        got = {r.id: (r.bounds, [tuple(f) for f in r.fixes]) for r in J.boundaries(spark.createDataFrame(rows, "id string, seq string"), table, k, leniency, compat, limit=0).collect()}
        assert got == want
        assert sum(len(f) for _, f in want.values()) > 50


def test_filter_mode_equals_model(spark):
    """Against a small filter with many false positives: the model asks the same bits."""
    seqs, known, table = _frames(spark)
    k, bits, hashes = 10, 3000, 2
    slices = bloom.build(known, k, bits, hashes)
    held = {p for c in known.collect() for p in bloom.locations([np.array([c.c0])], k, bits, hashes)[0].tolist()}
    has = lambda x: not x.strip("ACGT") and held.issuperset(bloom.locations([np.array([code_of(canonical_text(x))])], k, bits, hashes)[0].tolist())
    want = {r.id: (b, f) for r in seqs.collect() for b, f in [boundary_list(r.seq, k, 3, has)] if b}
    got = {r.id: (r.bounds, [tuple(f) for f in r.fixes]) for r in J.boundaries_by_filter(seqs, slices, k, bits, hashes, 3).collect()}
    assert got == want
    exact = {r.id: r.bounds for r in J.boundaries(seqs, known, k, 3).collect()}
    assert any(exact.get(i) != b for i, (b, _) in want.items())  # false positives change some


def test_gap_closed_by_a_probe_moves_on():
    """The start that closes the gap is itself missing: the scan goes on behind it."""
    seq, known = "ACTGTCGACGGGGACTGTC", kset(6, "ACTGTCGTGTCGACGCCA", "TTTCAGTTCAACGTGTAGCT", "GACGGGGTTTAGCCT")
    assert scan(seq, 6, 2, known) == boundary_list(seq, 6, 2, lambda x: canonical_text(x) in known)[0] == [1, 13]


def test_leniency():
    assert J.leniency_from_rate(10, 2.0, 0.05, 25) == 3 and J.leniency_from_rate(4, 2.0, 0.05, 25) == 4


def test_factor_sets_the_leniency(spark):
    """The default of 10 gives way to the factor; the filter's own rate counts in filter mode."""
    seqs, known, _ = _frames(spark, n=8)
    lists = lambda df: {r.id: r.bounds for r in df.collect()}
    assert J.leniency_from_rate(10, 0.5, 0.5, 12) == 3
    assert lists(J.boundaries(seqs, known, 12, 10, factor=0.5, rate=0.5)) == lists(J.boundaries(seqs, known, 12, 3))
    assert lists(J.boundaries(seqs, known, 10, 3, factor=6.0, rate=0.01)) == lists(J.boundaries(seqs, known, 10, 3))
    bits, hashes = 3000, 2
    slices = bloom.build(known, 10, bits, hashes)
    rate = (bloom.set_bits(slices).first()["set_bits"] / bits) ** hashes
    assert lists(J.boundaries_by_filter(seqs, slices, 10, bits, hashes, 10, factor=2.0)) == lists(J.boundaries_by_filter(seqs, slices, 10, bits, hashes, J.leniency_from_rate(10, 2.0, rate, 10)))


def test_bad_leniency(spark):
    with pytest.raises(ValueError):
        J.boundaries(spark.createDataFrame([("a", "ACGT")], "id string, seq string"), spark.createDataFrame([(1,)], "c0 bigint"), 10, 9)


@pytest.mark.parametrize("k", [1, 5, 31, 32, 50, 70])
def test_explode(spark, monkeypatch, k):
    monkeypatch.setattr("kmerloom.functions.codes.STEP", 97)
    seq = bases(500)
    rows = spark.createDataFrame([(1, seq), (2, "ACGTNACGTACG" + bases(80)), (3, "AC"), (4, None), (5, ""), (6, bases(k))], "id int, seq string")
    texts = {r.id: r.seq or "" for r in rows.collect()}
    got = {(r.id, r.x, r.kmer, r.canon) for r in kmers.with_text(kmers.explode_kmers(rows, k), k).collect()}
    want = {(i, x, s[x : x + k], canonical_text(s[x : x + k])) for i, s in texts.items() for x in range(len(s) - k + 1) if "N" not in s[x : x + k]}
    assert got == want
    known = kmers.kmer_set(spark.createDataFrame([(seq[10 : 10 + k],), ("N" * k,)], "kmer string"), k)
    hits = kmers.hit_vector(rows, known, k)
    assert hits.count() == sum(max(len(s) - k + 1, 0) for s in texts.values())
    one = canonical_text(seq[10 : 10 + k])
    assert hits.filter("hit").count() == sum(c == one for _, _, _, c in want)
    counted = {r.canon: r.n for r in kmers.set_text(kmers.count_kmers(rows, k).selectExpr("*"), k).groupBy("canon").count().withColumnRenamed("count", "n").collect()}
    assert set(counted) == {c for *_, c in want}


def test_runs_over_pieces(spark):
    seqs, known, table = _frames(spark)
    whole = {(r.id, r.s, r.e) for r in J.hit_runs(seqs, known, 10).collect()}
    parts = {(r.id, r.s, r.e) for r in J.hit_runs(seqs, known, 10, piece=7).collect()}
    want = set()
    for r in seqs.filter("length(seq) >= 15").collect():
        hit = [not r.seq[x : x + 10].strip("ACGT") and canonical_text(r.seq[x : x + 10]) in table for x in range(len(r.seq) - 9)]
        for x, h in enumerate(hit):
            if h and (not x or not hit[x - 1]):
                want.add((r.id, x, next((y for y in range(x, len(hit)) if not hit[y]), len(hit)) - 1))
    assert whole == parts == want


def test_a_boundary_list_is_worked_out_once(spark):
    """Records of many runs: the list must not be made anew for each of its places, on either side of the join."""
    runs = spark.createDataFrame([("a", 9000, 60 * i, 60 * i + 30) for i in range(150)] + [("b", 9000, 5, 6)], "id string, n int, s int, e int")
    seqs = spark.createDataFrame([("a", bases(9026)), ("b", bases(9026))], "id string, seq string")
    bounds = J.bounds_of_runs(runs, 25, 10)
    for found in (J.all_exons(seqs, bounds), J.confident_exons(seqs, bounds)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1
    rows = J.all_exons(seqs, bounds).orderBy("exon_no").collect()
    assert [(r.id, r.exon_no) for r in rows] == [("a", i) for i in range(150)] and rows[0].start == 1
