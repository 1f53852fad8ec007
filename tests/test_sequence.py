"""Column functions over sequences, names and numbers: golden values."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import nthash, sequence as S, text as X
from kmerloom.functions.codes import windows_of


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_complement_and_trim(spark):
    lit = F.lit
    got = one(
        spark, a=S.reverse_complement(lit("AACG")), b=S.reverse_complement(lit("acgN")), c=S.canonical(lit("TTTT")), d=S.trim_masked(lit("acGTaCGtt")),
        e=S.codes_and(lit("R"), lit("M")), f=S.codes_or(lit("A"), lit("G")), g=S.flatten_codes(lit("NRYK")), h=S.codes_nested(lit("A"), lit("R")),
        i=S.flatten_codes(lit("NRYK"), keep_n=False), j=S.has_codes(lit("ACN")), k=S.has_codes(lit("ACN"), count_n=False), l=S.codes_and(lit("a"), lit("r")),
    )
    assert got == {"a": "CGTT", "b": "Ncgt", "c": "AAAA", "d": "GTaCG", "e": "A", "f": "R", "g": "NACG", "h": True, "i": "AACG", "j": True, "k": False, "l": "a"}


def test_unknown_letter_raises(spark):
    with pytest.raises(Exception, match="unexpected character"):
        spark.range(1).select(S.checked_complement(F.lit("AXZ"))).collect()


def test_colours_round_trip(spark):
    got = one(spark, c=S.to_colours(F.lit("ACGGT")), b=S.from_colours(F.lit("A"), F.lit("1301")), n=S.to_colours(F.lit("ANg")), s=S.to_colours(F.lit("A")))
    assert got == {"c": "1301", "b": "ACGGT", "n": "Nn", "s": ""}


def test_overlay(spark):
    got = one(
        spark, a=S.overlay_sequence(F.lit("TT"), F.lit("AAAA"), F.lit(1)), b=S.overlay_sequence(F.lit("TT"), F.lit("AA"), F.lit(3)),
        c=S.overlay_sequence(F.lit("TT"), F.lit("AA"), F.lit(-3)), d=S.overlay_sequence(F.lit("AT"), F.lit("AAA"), F.lit(1), mask_new=True),
    )
    assert got == {"a": "ATTA", "b": "AANTT", "c": "TTNAA", "d": "AAt"}


@pytest.mark.parametrize(
    ("function", "value", "shown"),
    [
        (X.to_si, 1500.0, "1.5 k"), (X.to_si, 0.0, "0 "), (X.to_si, 999.6, "1e+03 "), (X.to_si, 2.5e6, "2.5 M"), (X.to_si, 0.25, "0.25 "), (X.to_si, 3.5e13, "35 T"),
        (X.bytes_to_si, 1536, "1.5k"), (X.bytes_to_si, 1023, "1023"), (X.bytes_to_si, 1 << 30, "1G"),
        (X.to_engineering, 1234567, "1234567"), (X.to_engineering, 12345678, "12.35e6"), (X.to_engineering, 21_275_000, "21.27e6"),
    ],
)
def test_numbers(spark, function, value, shown):
    assert one(spark, x=function(F.lit(value)))["x"] == shown


def test_significant_as_printf(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.concatenate((10.0 ** rng.uniform(-6, 6, 300), rng.integers(1, 99999, 200) / 1000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    off = [(r.v, r.a, r.b) for r in rows.select("v", X.significant(F.col("v"), 3).alias("a"), X.significant(F.col("v"), 4).alias("b")).collect() if (r.a, r.b) != (f"{r.v:.3g}", f"{r.v:.4g}")]
    assert not [x for x in off if x[0] >= 1]
    assert len(off) <= 2  # below 1 a tie in the shortest decimal form may round the other way


def test_parse_and_names(spark):
    got = one(
        spark, a=X.from_si(F.lit("2k")), b=X.from_si(F.lit("2kb")), c=X.from_si(F.lit("x")), d=X.si_to_bytes(F.lit("1.5k")), e=X.si_to_bytes(F.lit("7")),
        f=X.is_read_pair(F.lit("r/1"), F.lit("r/2")), g=X.is_read_pair(F.lit("r/2"), F.lit("r/1")), h=X.starts_with(F.lit("ab"), "ab"), i=X.chomp(F.lit("x\n")),
        j=X.transcript_of(F.lit("a_b_1_9")), k=X.exons_of(F.lit("c_1_5_OR_d_1_5")),
    )
    assert got == {"a": 2000.0, "b": 0.0, "c": 0.0, "d": 1536, "e": 7, "f": True, "g": False, "h": False, "i": "x", "j": "a_b", "k": ["c_1_5", "d_1_5"]}


def test_hash_definition():
    """Prefix form against the definition, base by base."""
    mask = (1 << 64) - 1
    rol = lambda v, s: ((v << s % 64) | (v >> (64 - s % 64))) & mask if s % 64 else v
    seq, k = "ACGTTGCAACGTAGGCTA" * 6, 70
    for x in (0, 5, len(seq) - k):
        kmer, f, r = seq[x : x + k], 0, 0
        for i, c in enumerate(kmer):
            f ^= rol(nthash.SEED[c], k - 1 - i)
            r ^= rol(nthash.SEED[{"A": "T", "C": "G", "G": "C", "T": "A"}[c]], i)
        got = nthash.window_hashes(seq, k)
        assert (int(got[0][x]), int(got[1][x])) == (f, r)
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert (nthash.canonical_hashes(seq, 25) == nthash.canonical_hashes(rc, 25)[::-1]).all()
    clean = [(int(r), int(x)) for _, row, place, inside, fine in windows_of(pa.array(["ACGNACGT", "NNN", None, "AC", "TTT"]), 3) for r, x, ok in zip(row, place, inside & fine, strict=True) if ok]
    assert clean == [(0, 0), (0, 4), (0, 5), (4, 0)]
    h = np.array([12345], np.uint64)
    t = 12345 * (2 ^ (25 * nthash.MULTI_SEED & mask)) & mask
    assert int(nthash.extra_hash(h, 25, 2)[0]) == t ^ (t >> 27)
    assert int(nthash.extra_hash(h, 25, 0)[0]) == 12345


def colours_one_by_one(seq):
    """Colours by the definition; letters that are no bases have none."""
    code = {c: i % 4 for i, c in enumerate("ACGTacgt")}
    out = ""
    for a, b in zip(seq, seq[1:]):
        if "N" in (a + b).upper():
            out += "n" if a.islower() or b.islower() else "N"
        elif a in code and b in code:
            out += str(code[a] ^ code[b])
    return out


def test_colours_of_a_batch(spark):
    """Texts beside one another, empty, null and with other letters, come out as each by itself; whole batches go through Arrow."""
    import random

    rng = random.Random(3)
    seqs = ["", "A", "n", "AC", "acgNNtA", "ARC", "TT.A", None, "é", "ACé", *("".join(rng.choice("ACGTacgtN") for _ in range(rng.randrange(40))) for _ in range(200))]
    frame = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string")
    coloured = frame.select("i", "seq", S.to_colours(F.col("seq")).alias("c"))
    assert {r.i: r.c for r in coloured.collect()} == {i: colours_one_by_one(s or "") for i, s in enumerate(seqs)}
    back = coloured.filter("seq rlike '^[ACGT]+$' or i = 7").select("seq", S.from_colours(F.substring("seq", 1, 1), F.col("c")).alias("b"))
    assert all(r.b == r.seq for r in back.collect()) and back.count() > 5
    assert "ArrowEvalPython" in coloured._jdf.queryExecution().executedPlan().toString()
    lone = spark.createDataFrame([("g", ""), ("g", "0123"), (None, "1"), ("T", None)], "a string, c string").select(S.from_colours(F.col("a"), F.col("c")).alias("b"))
    assert [r.b for r in lone.collect()] == ["g", "gGTCG", None, None]


def test_trim_looks_at_ends_only(spark):
    import time

    long_ = "A" + "b" * 200_000 + "C"  # a search for the end from each place took minutes
    began = time.time()
    got = one(spark, a=S.trim_masked(F.lit(long_)), b=S.trim_masked(F.lit("abc")), c=S.trim_masked(F.lit("aBcD\n")), d=S.trim_masked(F.lit("")))
    assert (got["a"], got["b"], got["c"], got["d"]) == (long_, "", "BcD\n", "") and time.time() - began < 20


def test_reads_of_long_texts(spark):
    """Reads across blocks, and a last one up to the end; a long text costs in proportion to its length."""
    import random
    import time

    from kmerloom.plans import derived as D

    rng = random.Random(5)
    sizes = [0, 1, 99, 100, 101, 150, 151, 3200, 3249, 3250, 3251, 3299, 3300, 3301, 6400, 6501, 9999]
    seqs = [None, *("".join(rng.choices("ACGT", k=n)) for n in sizes)]
    want = []
    for i, s in enumerate(seqs):
        over = max(len(s or "") - 100, 0)
        want += [(i, r, s[min(50 * r, over) : min(50 * r, over) + 100]) for r in range(-(-over // 50) + 1) if s]
    assert sorted(tuple(r) for r in D.windows(spark.createDataFrame(list(enumerate(seqs)), "doc_id int, seq string")).collect()) == want
    began = time.time()
    long_ = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ACGTTGCA"), 500_000).alias("seq"))
    assert D.windows(long_).count() == 79_999 and time.time() - began < 60


def test_once_keeps_one_table(spark, tmp_path):
    """Tables written on the way to a kept one, also inside another, go when it is written."""
    from kmerloom import storage

    spark.range(1).write.parquet(str(tmp_path / "t"))
    rounds = lambda df: storage.materialize(storage.materialize(df))
    inner = lambda: storage.once(spark, str(tmp_path / "t"), "inner", lambda: rounds(spark.range(5)))
    folder = storage.new_folder(spark, keep=True).rsplit("/", 1)[0]
    listed = lambda: {str(s.getPath()) for s in (lambda fs, at: fs.listStatus(at) if fs.exists(at) else [])(*storage._hadoop(spark, folder))}
    before = listed()
    outer = storage.once(spark, str(tmp_path / "t"), "outer", lambda: rounds(inner()))
    assert len(listed() - before) == 2 and outer.count() == 5 and inner().count() == 5
