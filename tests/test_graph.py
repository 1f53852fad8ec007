"""Splice graph, genes, Bloom filters, readers and writers on golden cases."""

import gzip
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kmerloom.functions import nthash
from kmerloom.functions.codes import decode
from kmerloom.operators import bloom, genes, kmers, splicegraph as G
from kmerloom.operators.components import connected_components
from kmerloom.sources import readers, writers


def _exons(spark, rows):
    return G.parse_headers(spark.createDataFrame([(i, h, s) for i, (h, s) in enumerate(rows)], "rec_no bigint, id string, seq string"))


def test_headers(spark):
    got = _exons(spark, [("R1_7_31_60", "A"), ("TX_1_30", "C")]).orderBy("rec_no").collect()
    assert [(r.name, r.exon, r.start, r.end) for r in got] == [("R17", "R17_31_60", 31, 60), ("TX", "TX_1_30", 1, 30)]


def test_blocks(spark):
    rows = [(h, "A" * 50) for h in ("a_1_100", "a_100_200", "a_200_300", "b_1_90", "c_1_80", "c_80_150")]
    blocks = G.exon_blocks(_exons(spark, rows))
    assert {(r.src, r.dst) for r in G.chain_edges(blocks).collect()} == {("a_1_100", "a_100_200"), ("a_100_200", "a_200_300"), ("c_1_80", "c_80_150")}
    assert {r.exon: r.terminal for r in blocks.collect()} == {"a_1_100": True, "a_100_200": False, "a_200_300": True, "c_1_80": True, "c_80_150": True}
    index = G.end_index(blocks)
    assert {r.exon for r in index.filter("side = 'start'").collect()} == {"a_100_200", "a_200_300", "c_80_150"}
    assert {r.exon for r in index.filter("side = 'end'").collect()} == {"a_1_100", "a_100_200", "c_1_80"}


def _labels(spark, members):
    blocks = spark.createDataFrame([(i, n, "A" * size, bool(t)) for i, (n, size, t) in enumerate(members)], "rec_no bigint, exon string, seq string, terminal boolean")
    first = min(n for n, *_ in members)
    component = spark.createDataFrame([(n, first) for n, *_ in members], "exon string, component string")
    return {r.exon: r.label for r in G.merge_labels(G.merge_exons(blocks, component)).collect()}


def test_labels(spark):
    assert _labels(spark, [("x", 100, 0), ("y", 98, 0)]) == {"x": "x_OR_y", "y": "x_OR_y"}
    assert _labels(spark, [("x", 100, 0), ("y", 95, 0)]) == {"x": "x_OR_y", "y": "x_OR_y"}
    assert _labels(spark, [("x", 100, 0), ("y", 94, 0)]) == {"x": "x"}
    assert _labels(spark, [("x", 100, 0), ("y", 94, 0), ("z", 60, 1)]) == {"x": "x_OR_z", "z": "x_OR_z"}
    assert _labels(spark, [("x", 100, 1), ("z", 60, 1)]) == {"x": "x_OR_z", "z": "x_OR_z"}


def test_genes_from_dot(spark, tmp_path):
    (tmp_path / "g.dot").write_text("digraph graphname {\na_1_9->a_9_20;\nb_1_9->a_9_20;\nc_1_5_OR_d_1_5->c_5_9;\n\n}")
    edges = readers.read_dot(spark, [str(tmp_path / "g.dot")])
    found = genes.genes(edges)
    assert {r.exon: r.gene for r in found.collect()} == {"a_1_9": 1, "a_9_20": 1, "b_1_9": 1, "c_1_5_OR_d_1_5": 2, "c_5_9": 2}
    assert {(r.transcript, r.gene) for r in genes.transcript_genes(found).collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2)}
    text = [r.value for r in writers.clustered_dot_text(genes.subgraph_edges(edges, found)).collect()]
    assert text[0] == "digraph graphname {" and text[1] == "subgraph graphname_cc_0 {" and text[-2:] == ["}", "}"] and len(text) == 9
    assert writers.dot_text(edges).count() == 5
    writers.write_exon_genes(found, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["ExonID", "GeneID"]


def test_components(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30] + [("n070", "n070")]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == {f"n{i:03d}": "n000" if i <= 30 else "n031" for i in range(61)}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_bloom(spark, tmp_path):
    known = kmers.kmer_set(spark.createDataFrame([(k,) for k in ("ACGTACGTAC", "AAAAAAAAAA", "ACCCCCCCCC")], "kmer string"), 10)
    bits, hashes = bloom.size_for(1000, 0.01)
    assert (bits, hashes) == (9585, 6)
    slices = bloom.build(known, 10, bits, hashes)
    body = bytes(slices.first().body)
    texts = [r.canon for r in kmers.set_text(known, 10).collect()]
    firsts = [nthash.canonical_hashes(t, 10)[:1] for t in texts]
    places = {int(nthash.extra_hash(h, 10, i)[0]) % bits for h in firsts for i in range(hashes)}
    assert {i for i in range(bits) if body[i // 8] >> (7 - i % 8) & 1} == places
    assert bloom.set_bits(slices).first().set_bits == len(places)
    asked = known.unionByName(kmers.kmer_set(spark.createDataFrame([("ACGTTTTTTT",)], "kmer string"), 10))
    found = lambda s: {r.canon: r.present for r in bloom.probe(asked, s, 10, bits, hashes).select(decode(10).alias("canon"), "present").collect()}
    want = {"AAAAAAACGT": False} | dict.fromkeys(texts, True)
    assert found(slices) == want
    (tmp_path / "B.bf").write_bytes(body)
    assert found(bloom.slices_of_file(spark, str(tmp_path / "B.bf"))) == want
    writers.write_filter(slices, str(tmp_path / "slices"))
    assert found(spark.read.parquet(str(tmp_path / "slices"))) == want
    f0, share = bloom.frequency_estimates({1: 3000, 2: 500})
    assert f0 > 0 and 0 < share[1] < 1 and bloom.frequency_estimates({})[0] == 0


def test_bloom_over_slices(spark, monkeypatch):
    monkeypatch.setattr(bloom, "SLICE", 64)
    letters = random.Random(3)
    seqs = spark.createDataFrame([("".join(letters.choice("ACGT") for _ in range(400)),) for _ in range(3)], "seq string")
    known = kmers.reference_set(seqs, 40)
    bits, hashes = bloom.size_for(1083, 0.01)
    body = b"".join(bytes(r.body) for r in bloom.build(known, 40, bits, hashes).orderBy("slice").collect())
    want = {int(nthash.extra_hash(nthash.canonical_hashes(r.seq, 40), 40, i)[x]) % bits for r in seqs.collect() for x in range(361) for i in range(hashes)}
    assert {i for i in range(bits) if body[i // 8] >> (7 - i % 8) & 1} == want


def test_estimate(spark):
    letters = random.Random(4)
    texts = ["".join(letters.choice("ACGT") for _ in range(3000)) for _ in range(8)]
    seqs = spark.createDataFrame([(t,) for t in [*texts, texts[0], "ACGTN"]], "seq string")
    counted: dict = {}
    for t in [*texts, texts[0]]:
        for h in nthash.canonical_hashes(t, 25).tolist():
            if h >> 59 == 1:
                counted[h & 1023] = counted.get(h & 1023, 0) + 1
    got = {r.copies: r.buckets for r in bloom.bucket_histogram(seqs, 25, 4, 10).collect()}
    assert got == dict(Counter(counted.values()))
    row = bloom.estimate_distinct(seqs, 25, 4, 10).first()
    assert abs(row.distinct_estimate - 8 * 2976) < 3000 and abs(row.repeated_estimate - 2976) < 2500
    assert bloom.estimate_distinct(seqs.limit(0), 25).first().distinct_estimate == 0


def test_counts(spark):
    reads = spark.createDataFrame([("AAAAA",), ("TTTTT",), ("ACGNA",)], "seq string")
    assert [(r.c0, r.n) for r in kmers.count_kmers(reads, 4).collect()] == [(0, 4)]
    assert [r.canon for r in kmers.set_text(kmers.solid_set(reads, 4), 4).collect()] == ["AAAA"]
    assert kmers.kmer_totals(reads, 4).first().asDict() == {"total_kmers": 4, "distinct_kmers": 1, "repeated_kmers": 1}
    assert kmers.kmer_totals(reads.limit(0), 4).first().total_kmers == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first one\nACGT\nacgt\n>r2\nTTTT\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">r3\nGG\n#note\nCC")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa.gz\n")
    got = readers.read_sequences(spark, [f"@{tmp_path}/list"]).orderBy("rec_no").collect()
    assert [(r.rec_no, r.id, r.comment, r.seq) for r in got] == [(0, "r1", "first one", "ACGTacgt"), (1, "r2", "", "TTTT"), (2, "r3", "", "GGCC")]
    back = [r.value for r in writers.fasta_text(readers.read_fasta(spark, [str(tmp_path / "a.fa")])).collect()]
    assert sorted(back) == [">r1 first one\nACGTacgt", ">r2\nTTTT"]


def test_fastq_and_quality(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a 1:N:0:XX\nacGTTNgg\n+\n!!IIII!!\n@b 1:Y:0:XX\nAC\n+\nII\n")
    reads = readers.read_fastq(spark, [str(tmp_path / "r.fq")])
    assert readers.sniff("@a 1:N:0:XX") == "fastq"
    kept = readers.casava(readers.clean(reads)).collect()
    assert [(r.id, r.seq, r.qual) for r in kept] == [("a", "GTTN", "IIII")]  # an id of one letter gets no mate suffix
    trimmed = readers.trim_quality(reads, 10).orderBy("rec_no").first()
    assert (trimmed.seq, trimmed.qual) == ("GTTN", "IIII")
    assert readers.mask_quality(reads, 10).orderBy("rec_no").first().seq == "NNGTTNNN"
    assert readers.cap_length(reads, 1).orderBy("rec_no").first().seq == "a"
    shifted = readers.shift_quality(spark.createDataFrame([("A", "h")], "seq string, qual string"), 64).first()
    assert shifted.qual == "I"
    assert readers.check_lengths(reads).count() == 2


def test_sam_and_qseq(spark, tmp_path):
    rows = ["@HD\tVN:1", "r\t65\tc\t1\t9\t4M\t*\t0\t0\tACGT\tIIII", "r\t145\tc\t1\t9\t4M\t*\t0\t0\tAACC\tABCD", "s\t256\tc\t1\t9\t4M\t*\t0\t0\tAAAA\t*"]
    (tmp_path / "x.sam").write_text("\n".join(rows) + "\n")
    got = readers.read_sam(spark, [str(tmp_path / "x.sam")]).orderBy("rec_no").collect()
    assert [(r.id, r.comment, r.seq, r.qual) for r in got] == [("r/1", "1:N:0:", "ACGT", "IIII"), ("r/2", "2:N:0:", "GGTT", "DCBA")]
    assert readers.sniff(rows[0]) == readers.sniff(rows[1]) == "sam"
    (tmp_path / "q.txt").write_text("M\t1\t2\t3\t4\t5\t0\t3\tACGT\thhhh\t1\nM\t1\t2\t3\t4\t5\t0\t1\tACGT\thhhh\t0\n")
    q = readers.read_qseq(spark, [str(tmp_path / "q.txt")]).collect()
    assert [(r.id, r.comment) for r in q] == [("M:1:2:3:4:5/2", "3:N:0:")]
    (tmp_path / "B.inf").write_text("10 2 25 0.01\n20 3 25 0.02\n")
    assert readers.read_filter_info(spark, str(tmp_path / "B.inf")) == {"bits": 20, "hashes": 3, "k": 25, "rate": 0.02}
    assert readers.split_option("") == [] and readers.split_option("AG,TG") == ["AG", "TG"]


def test_colour_reads(spark):
    got = readers.clean(spark.createDataFrame([("T0123", "", "1")], "seq string, qual string, id string")).first()
    assert (got.anchor, got.seq) == ("T", "123")
    assert F.col("x") is not None


def test_cascade(spark):
    """Second plane: places set by two occurrences or more, over batches and tasks; every k-mer found twice is in it."""
    own = random.Random(3)
    seqs = ["".join(own.choice("ACGT") for _ in range(60)) for _ in range(40)]
    reads = [s[a : a + 30] for s in seqs for a in own.sample(range(30), 4)] + ["ACGTN" * 5]
    k, bits, hashes = 9, 20_011, 4
    frame = spark.createDataFrame([(r,) for r in reads], "seq string").repartition(7)
    counted = {r["c0"]: r["n"] for r in kmers.count_kmers(frame, k).collect()}
    places = {c: set(bloom.locations([np.array([c])], k, bits, hashes)[0].tolist()) for c in counted}
    times = Counter()
    for c, n in counted.items():
        for p in places[c]:
            times[p] += n
    planes = bloom.cascade(frame, k, bits, hashes)
    bits_of = lambda c: set(np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(bytes(r[c]) for r in planes.orderBy("slice").collect()), np.uint8))).tolist())
    assert bits_of("body") == set(times) and bits_of("again") == {p for p, n in times.items() if n >= 2}
    asked = spark.createDataFrame([(c,) for c in counted], "c0 bigint")
    found = {r["c0"]: r["present"] for r in bloom.probe(asked, bloom.second_plane(planes), k, bits, hashes).collect()}
    assert found == {c: all(times[p] >= 2 for p in places[c]) for c in counted}
    assert all(found[c] for c, n in counted.items() if n >= 2) and not all(found.values())
    assert bloom.cascade(frame.limit(0), k, bits, hashes).count() == 0


def test_quality_shift_of_plain_strings(spark):
    """All values from -5 to 41 in one string, and one beyond them; no string is taken apart but for the error."""
    import pytest

    every = "".join(chr(64 + x) for x in range(-5, 42))
    frame = spark.createDataFrame([("A", every), ("A", ""), ("A", None)], "seq string, qual string")
    moved = readers.shift_quality(frame, 64)
    assert [r.qual for r in moved.collect()] == ["".join(chr(max(x, 0) + 33) for x in range(-5, 42)), "", None]
    assert "translate" in moved._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="out of range"):
        readers.shift_quality(spark.createDataFrame([("A", "h:")], "seq string, qual string"), 64).collect()


def test_shared_ends(spark, monkeypatch):
    """Links and groups of end k-mers against all pairs: other letters, names that repeat, a k-mer that most exons have, few ends at a time; no k-mer travels by itself."""
    monkeypatch.setattr(G, "BUFFER", 7)
    own = random.Random(8)
    ends = ["".join(own.choice("ACGT") for _ in range(12)) for _ in range(5)] + ["ACGTNACGTACN", "ACGTNACGTACG", "é" + "ACGTACGTACG"]
    rows = [(i, f"x{own.randrange(90)}", own.choice(ends) + own.choice("ACGT") * 3 + own.choice(ends), own.random() < 0.2, own.random() < 0.2) for i in range(120)] + [(120, "y", "ACGT", False, False)]
    blocks = spark.createDataFrame(rows, "rec_no bigint, exon string, seq string, is_first boolean, is_last boolean").repartition(5)
    k, n = 9, 3
    groups: dict = {}
    for _, exon, seq, first, last in rows:
        if len(seq) >= k + n - 1:
            for i in range(n):
                if not first:
                    groups.setdefault(("start", seq[i : i + k]), set()).add(exon)
                if not last:
                    groups.setdefault(("end", seq[len(seq) - k - i : len(seq) - i]), set()).add(exon)
    groups = {key: e for key, e in groups.items() if len(e) > 1}
    assert {(r.side, r.kmer): (r.exons, r.first_exon) for r in G.shared_groups(blocks, k, n).collect()} == {key: (len(e), min(e)) for key, e in groups.items()}
    root = {e: e for g in groups.values() for e in g}
    for _ in root:
        for g in groups.values():
            least = min(root[e] for e in g)
            root.update((e, least) for e in g)
    assert {r.exon: r.component for r in G.exon_components(blocks, k, n).collect()} == root
    sent = G._by_bucket(G.end_bases(blocks, "rec_no", k, n), k, True)
    assert sent.filter("kind = 'codes'").count() < 120 * 2 * n / 2


def test_components_of_numbers(spark, monkeypatch):
    """Longs are put together where they lie: long chains need few rounds, whatever order links come in; nodes told by a name that appears first in one line."""
    from kmerloom.operators import components

    monkeypatch.setattr(components, "BUFFER", 50)
    own = random.Random(6)
    pairs = [(i, i + 1) for i in range(900) if i % 300 != 299] + [(own.randrange(1000, 1100), own.randrange(1000, 1100)) for _ in range(60)] + [(2000, 2000)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    links = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(6)
    want = {n: r for n, r in root.items() if n != 2000 and any(n in p and p[0] != p[1] for p in pairs)}
    assert {r.node: r.root for r in connected_components(links, max_rounds=6).collect()} == want
    assert connected_components(links.limit(0)).count() == 0
    edges = spark.createDataFrame([(3, "b", "a"), (1, "z", "y"), (2, "y", "y"), (5, "q", "q"), (4, "a", "z2")], "line_no bigint, src string, dst string")
    assert {r.exon: r.gene for r in genes.genes(edges).collect()} == {"z": 1, "y": 1, "b": 2, "a": 2, "z2": 2, "q": 3}


def test_bits_and_places_at_once(spark):
    """Bits are counted and places put in order without a step for each byte or a hash table."""
    own = np.random.default_rng(2)
    bodies = [own.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 999, 65536)]
    slices = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "slice bigint, body binary").repartition(2)
    found = bloom.set_bits(slices)
    assert found.first().set_bits == sum(int.from_bytes(b, "big").bit_count() for b in bodies)
    assert bloom.set_bits(slices.limit(0)).first().set_bits == 0
    assert "hex(" not in found._jdf.queryExecution().optimizedPlan().toString()
    at = own.integers(0, 500, (300, 6))
    assert bloom.sorted_distinct(at).tolist() == sorted(set(at.ravel().tolist())) and not len(bloom.sorted_distinct(at[:0]))
