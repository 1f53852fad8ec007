"""k-mers dealt by minimizers against the plain way, one row for each k-mer."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.codes import code_names
from kmerloom.operators import kmers, superkmers


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(1)
    own = ["".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(rng.randrange(300))) for _ in range(60)]
    own += [*own[:20], "A" * 700, "AC" * 500, ""]  # copies, and stretches longer than MOST
    return spark.createDataFrame(list(enumerate(own)), "id int, seq string")


@pytest.mark.parametrize("k", [5, 25, 40])
def test_counts(seqs, k):
    want = kmers.explode_kmers(seqs, k, keep=[]).groupBy(*code_names(k)).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, kmers.count_kmers(seqs, k).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [25, 40])
def test_absent_and_members(seqs, k):
    held = seqs.filter("id % 2 = 0 and id % 3 > 0")
    names = code_names(k)
    known = kmers.explode_kmers(held, k, keep=[]).select(*names).distinct()
    want = {(r["id"], r["x"]) for r in kmers.missing_kmers(seqs, known, k, valid_only=False).collect()}
    got = [(r["id"], x) for r in superkmers.absent_runs(seqs, superkmers.deal(held, k), k).collect() for x in range(r["a"], r["b"] + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    asked = kmers.explode_kmers(seqs, k, keep=[]).select(*names)
    found = superkmers.members(asked, superkmers.deal(held, k), k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, asked.join(known, names, "left_semi").distinct().collect()))


def test_what_is_sent(spark):
    """Two bytes for a k-mer at most; a count took a row of its own for each before."""
    rng = random.Random(2)
    own = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(400_000)),)], "seq string")
    sent = superkmers.deal(own, 25).agg(F.sum(F.length("sizes") + F.length("bases")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    assert sent["n"] < 2 * 400_000 and sent["rows"] <= superkmers.BUCKETS


def test_places_are_sent_in_few_rows(spark):
    """A filter's places go in one row for each slice and BUFFER k-mers; before, in one for each slice and Arrow batch."""
    import numpy as np
    import pandas as pd

    from kmerloom.operators import bloom

    frames = iter([pd.DataFrame({"c0": np.arange(1000)}) for _ in range(50)])
    assert [len(c) for c, in bloom._buffered(frames, ["c0"])] == [50_000]
    at = np.unique(np.random.default_rng(1).integers(0, 3 * bloom.SLICE, 10_000))
    sent = bloom._sent(at)
    assert np.array_equal(np.concatenate([bloom._received(r) + r.slice * bloom.SLICE for r in sent.itertuples()]), at) and len(sent) == 3
    assert not len(bloom._sent(at[:0]))


def test_copies_are_sent_once(spark):
    """Copies of a stretch travel once, with the number, keys and places of all; before, its bases went once for each."""
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(20_000))
    one = spark.createDataFrame([("a0", text)], "id string, seq string").coalesce(1)
    four = spark.createDataFrame([(f"a{i}", text) for i in range(3)] + [(None, text)], "id string, seq string").coalesce(1)
    size = lambda df, c: df.agg(F.sum(F.length(c))).first()[0]
    assert size(superkmers.deal(four, 25), "bases") == size(superkmers.deal(one, 25), "bases")
    assert {r["n"] for r in kmers.count_kmers(four, 25).collect()} == {4}
    held = spark.createDataFrame([(text[:9_000],)], "seq string")
    got = superkmers.absent_runs(four, superkmers.deal(held, 25), 25)
    starts = {(r["id"], x) for r in got.collect() for x in range(r["a"], r["b"] + 1)}
    assert starts == {(i, x) for i in ("a0", "a1", "a2", None) for x in range(9_000 - 24, 20_000 - 24)}
    assert size(superkmers.deal(four, 25, "id"), "owners") < 4 * 7 * size(superkmers.deal(one, 25), "sizes")


def test_passes_are_the_whole(seqs):
    """Two passes over the buckets shuffle about half of the stretches each and find the same starts."""
    held = seqs.filter("id % 2 = 0 and id % 3 > 0")
    starts = lambda df: sorted((r["id"], x) for r in df.collect() for x in range(r["a"], r["b"] + 1))
    parts = [superkmers.absent_runs(seqs, superkmers.deal(held, 25, share=(i, 2)), 25, share=(i, 2)) for i in range(2)]
    assert starts(parts[0].unionByName(parts[1])) == starts(superkmers.absent_runs(seqs, superkmers.deal(held, 25), 25))
    sent = [superkmers.deal(seqs, 25, share=s).agg(F.sum(F.length("sizes"))).first()[0] for s in ((0, 2), (1, 2), (0, 1))]
    assert sent[0] + sent[1] == sent[2] and max(sent[:2]) < 0.7 * sent[2]


def test_metrics_write_no_kmers(spark, monkeypatch):
    """The counted k-mers are observed and dropped; before, they were written to be read by none."""
    from kmerloom.plans import queries

    def none(*args, **more):
        raise AssertionError("a table was written")

    monkeypatch.setattr(queries, "materialize", none)
    assert queries.run_metrics(spark, "/root/testdata/sf0.001").first()["total"] > 0


def test_reads_pass_to_the_count(spark, monkeypatch):
    """Queries that count the reads' k-mers do not write the reads; before, they were written and read again."""
    from kmerloom.plans import derived, queries

    def none(*args, **more):
        raise AssertionError("the reads were written")

    monkeypatch.setattr(derived, "once", none)
    for name in ("kmer_solid", "bloom_sizing", "solid_filter_counts", "run_metrics"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_record_kmers(spark, tmp_path, monkeypatch):
    """k-mers of whole records: other letters, short and empty and null ones, few bases at a time, wide k-mers; none is shuffled. Documents in several rows count once."""
    import duckdb

    from kmerloom.plans import queries as Q

    monkeypatch.setattr(kmers, "PART", 100)
    own = random.Random(7)
    seqs = ["".join(own.choice("ACGTN" if i % 3 else "AC") for _ in range(own.randrange(150))) for i in range(60)] + ["", None, "ACGTACGTAC" * 30]
    frame = spark.createDataFrame(list(enumerate(seqs)), "id bigint, seq string").repartition(3)
    for k in (5, 30, 40):
        got = kmers.record_kmers(frame, k, "id")
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
        names = code_names(k)
        want = kmers.explode_kmers(frame, k).groupBy("id").agg(
            F.count(F.lit(1)).alias("kmers"), F.sum("x").alias("places"), F.min(F.struct(*names)).alias("c"), F.max("x").alias("last_x"), F.count_distinct(*names).alias("distinct_kmers")
        ).select("id", "kmers", "places", "c.*", "last_x", "distinct_kmers")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()}
    text = ["the quick brown fox jumps over the lazy dog and runs 4 miles " * 3, "the quick brown fox jumps over the lazy cat", "x"]
    rows = [(1, text[0]), (2, text[1]), (2, text[0][9:]), (3, text[1]), (None, text[0]), (None, text[1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("kmer_explode", "kmer_masked"):
        got = Q.queries()[name](spark, str(tmp_path))
        columns = ", ".join(got.columns)
        assert {tuple(r) for r in got.collect()} == set(con.execute(f"SELECT {columns} FROM ({Q.oracle_sql()[name]})").fetchall())


def test_members_are_asked_packed(spark, seqs, monkeypatch):
    """Questions go to the buckets of the k-mers they ask for, each once in a task and in few rows; minimizers are those of the k-mers' bases."""
    import numpy as np

    monkeypatch.setattr(superkmers, "ASKED", 300)
    for k in (5, 25, 31, 40):
        asked = kmers.explode_kmers(seqs, k, keep=[]).select(*code_names(k))
        codes = [np.array([r[i] for r in asked.limit(200).collect()], np.int64) for i in range(len(code_names(k)))]
        bases = np.stack([c >> 2 * (w - 1 - i) & 3 for c, w in zip(codes, superkmers.widths(k), strict=True) for i in range(w)], axis=1).astype(np.uint8)
        assert (superkmers._minimizers_of(codes, k) == superkmers._minimizers(bases.ravel(), k)[::k]).all()
        held = superkmers.deal(seqs.filter("id % 3 = 0"), k)
        found = superkmers.members(asked, held, k)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, superkmers.counted(held, k).select(*code_names(k)).collect()))
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
