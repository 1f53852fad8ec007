"""Records in pieces with a halo against whole strings, for pieces of 64 bases up to the whole record and splits anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import kmers, superkmers
from kmerloom.operators.lookup import canonical_text
from kmerloom.sources import pieces
from tests.test_readers import split_at  # noqa: F401

K = 7


def genome(rng):
    return ["".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(n)) for n in (0, 3, 64, 70, 128, 1000, 5, 777)]


def fasta(path, records, rng):
    out = []
    for i, seq in enumerate(records):
        out.append(f">c{i} note")
        at = 0
        while at < len(seq):
            n = rng.choice([1, 10, 60, 200])
            out += [seq[at : at + n], *(["# a note", ""] if rng.random() < 0.1 else [])]
            at += n
    path.write_text("\n".join(out) + "\n")


@pytest.mark.parametrize(("size", "split"), [(64, 90), (64, 10**9), (100, 37), (10**6, 200), (10**6, 10**9)])
def test_pieces_are_the_record(spark, split_at, tmp_path, size, split):  # noqa: F811
    rng = random.Random(size + split)
    files = [genome(rng), genome(rng)[4:]]
    for n, records in enumerate(files):
        fasta(tmp_path / f"g{n}.fa", records, rng)
    split_at(split)
    paths = [str(tmp_path / f"g{n}.fa") for n in range(2)]
    whole = [s for records in files for s in records]
    got = {(r["rec_no"], r["piece"]): (r["start"], r["bases"]) for r in pieces.read_pieces(spark, paths, K - 1, size).collect()}
    want = {(n, a // size): (a, s[a : a + size + K - 1]) for n, s in enumerate(whole) for a in range(0, len(s), size)}
    assert got == want
    assert {(r["rec_no"], r["header"]) for r in pieces.read_headers(spark, paths).collect()} == {(n, f"c{i} note") for n, i in enumerate([*range(8), *range(4)])}
    cut = pieces.cut_pieces(spark.createDataFrame(list(enumerate(whole)), "rec_no bigint, seq string"), K - 1, size)
    assert {(r["rec_no"], r["piece"]): (r["start"], r["bases"]) for r in cut.collect()} == want


@pytest.mark.parametrize("size", [64, 200, 10**6])
def test_runs_over_pieces(spark, size):
    rng = random.Random(4)
    whole = genome(rng)
    known = {canonical_text(s[x : x + K]) for s in whole for x in range(0, len(s) - K + 1) if "N" not in s[x : x + K] and rng.random() < 0.97}
    table = kmers.kmer_set(spark.createDataFrame([(x,) for x in sorted(known)], "kmer string"), K)
    cut = pieces.cut_pieces(spark.createDataFrame(list(enumerate(whole)), "rec_no bigint, seq string"), K - 1, size)
    want = set()
    for n, s in enumerate(whole):
        hits = [canonical_text(s[x : x + K]) in known for x in range(len(s) - K + 1)]
        for x, hit in enumerate(hits):
            if hit and (not x or not hits[x - 1]):
                want.add((n, x, next((y for y in range(x, len(hits)) if not hits[y]), len(hits)) - 1))
    assert {tuple(r) for r in kmers.piece_runs(cut, table, K).collect()} == want
    # a record without any miss is one run
    every = kmers.reference_set(spark.createDataFrame([(whole[5],)], "seq string"), K)
    assert "N" in whole[5] or [tuple(r) for r in kmers.piece_runs(cut.filter("rec_no = 5"), every, K).collect()] == [(5, 0, len(whole[5]) - K)]
    rows = {(r["rec_no"], r["x"]) for r in kmers.explode_pieces(cut, K).collect()}
    assert rows == {(n, x) for n, s in enumerate(whole) for x in range(len(s) - K + 1) if "N" not in s[x : x + K]}


@pytest.mark.parametrize(("size", "split"), [(64, 10**9), (64, 90), (100, 37)])
def test_record_over_part_files(spark, split_at, tmp_path, size, split):  # noqa: F811
    rng = random.Random(size * split)
    whole = genome(rng)
    fasta(tmp_path / "all.fa", whole, rng)
    lines = (tmp_path / "all.fa").read_text().splitlines(keepends=True)
    stops = sorted(rng.sample(range(1, len(lines)), 12))  # many part files hold the middle of a record and no header
    folder = tmp_path / "parts"
    folder.mkdir()
    for n, (a, b) in enumerate(zip([0, *stops], [*stops, len(lines)], strict=True)):
        (folder / f"part-{n:05}.txt").write_text("".join(lines[a:b]))
    split_at(split)
    got = {(r["rec_no"], r["piece"]): (r["start"], r["bases"]) for r in pieces.read_pieces(spark, [str(folder)], K - 1, size).collect()}
    assert got == {(n, a // size): (a, s[a : a + size + K - 1]) for n, s in enumerate(whole) for a in range(0, len(s), size)}


def test_bad_halo(spark):
    with pytest.raises(ValueError):
        pieces.read_pieces(spark, ["x"], 5, 5)


def test_counts_and_misses_by_bucket(spark):
    """Figures of records in pieces, and their misses as runs, against k-mers one by one: other letters, records that share k-mers, one without k-mers."""
    own = random.Random(12)
    seqs = ["".join(own.choice("ACGT") for _ in range(n)) for n in (300, 90, 41, 3)] + ["ACGTTGCA" * 40, "ACGTN" * 30]
    seqs[1] = seqs[0][50:120] + seqs[1]
    rows = spark.createDataFrame(list(enumerate(seqs)), "rec_no bigint, seq string")
    cut = pieces.cut_pieces(rows, K - 1, 32).repartition(4)
    every = kmers.explode_pieces(cut, K)
    counted, distinct = kmers.piece_counts(cut, K)
    want = every.groupBy("rec_no").agg(F.count(F.lit(1)), F.sum("x"), F.max("x"), F.count_distinct("c0"))
    assert {tuple(r) for r in counted.join(distinct, "rec_no").collect()} == {tuple(r) for r in want.collect()}
    known = spark.createDataFrame([(seqs[0][20:200],), (seqs[4][3:40],)], "seq string")
    missed = kmers.piece_misses(cut, superkmers.deal(known, K), K)
    one_by_one = kmers.piece_runs(cut, kmers.reference_set(known, K), K)
    assert {tuple(r) for r in kmers.runs_of_pieces(cut, missed, K).collect()} == {tuple(r) for r in one_by_one.collect()}
    whole = superkmers.absent_runs(rows, superkmers.deal(known, K), K, "rec_no")
    got = [tuple(r) for r in kmers.kmers_of_runs(rows, whole, K, "rec_no").collect()]
    assert sorted(got) == sorted((r.rec_no, r.x, r.kmer) for r in kmers.with_text(kmers.missing_kmers(rows, kmers.reference_set(known, K), K, "rec_no"), K).collect())
    assert superkmers.size(superkmers.deal(rows, K), K) == kmers.reference_set(rows, K).count()
