"""Records and numbers from file splits, against a reader that goes line by line; splits fall inside every kind of record."""

import random

import pytest

from kmerloom.sources import readers, records, splits


@pytest.fixture
def split_at(spark):
    """Sets the size of file splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def set_(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield set_
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def records_of(lines):
    """(kind, header, seq, qual) one by one."""
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.startswith("#") or not line.strip() or (line[:1] == "@" and line[1:3].isalpha() and line[3:4] == "\t"):
            continue
        if line.startswith(">"):
            seq, i = lines[i : i + 1], i + 1
            while i < len(lines) and lines[i][:1] not in (">", "#"):
                seq.append(lines[i])
                i += 1
            out.append((">", line, "".join(seq), None))
        elif line.startswith("@"):
            out.append(("@", line, lines[i], lines[i + 2]))
            i += 3
        else:
            out.append(("line", line, "", None))
    return out


def some_lines(rng, n):
    bases = lambda k: "".join(rng.choice("ACGTacgtN") for _ in range(k))
    out = []
    for i in range(n):
        kind = rng.choice(["fasta", "fastq", "sam", "qseq", "note", "head", "blank"])
        size = rng.randrange(1, 30)
        if kind == "fasta":
            out += [f">f{i} x y", *(bases(rng.randrange(1, 20)) for _ in range(rng.randrange(1, 6)))]
            out += rng.choice([["# ends it"], [">f{i}b", bases(4), "#"]])
        elif kind == "fastq":  # quality lines that look like other lines
            out += [f"@qq{i} 1:N:0:A", bases(size), "+", rng.choice([">", "@", "#", "I", "+"]) * size]
        elif kind == "sam":
            s = bases(size).upper()
            out.append("\t".join([f"s{i}", str(rng.choice([0, 16, 65, 145, 256, 512])), "c", "1", "9", "*", "*", "0", "0", s, "I" * size]))
        elif kind == "qseq":
            out.append("\t".join(["M", "1", "2", "3", "4", "5", "0", rng.choice("13"), bases(size).upper(), "h" * size, rng.choice("01")]))
        else:
            out.append({"note": "# note", "head": "@HD\tVN:1", "blank": ""}[kind])
    return out


@pytest.mark.parametrize("size", [40, 97, 1000, 10**9])
def test_records_cut_anywhere(spark, split_at, tmp_path, size):
    rng = random.Random(size)
    files = []
    for n, count in enumerate((30, 0, 1, 12)):
        lines = some_lines(rng, count)
        (tmp_path / f"m {n}+é.txt").write_text("".join(x + "\n" for x in lines), encoding="utf-8")
        files.append((str(tmp_path / f"m {n}+é.txt"), lines))
    rng.shuffle(files)
    files.append(files[0])
    split_at(size)
    want = [r for _, lines in files for r in records_of(lines)]
    paths = [p for p, _ in files]
    assert splits.read_rows(spark, paths).rdd.getNumPartitions() > (20 if size == 40 else 0)
    for letters in (records.BROADCAST_LETTERS, -1):
        records.BROADCAST_LETTERS, kept = letters, records.BROADCAST_LETTERS
        got = records.cut_records(spark, paths).orderBy("rec_no").collect()
        records.BROADCAST_LETTERS = kept
        assert [r["rec_no"] for r in got] == list(range(len(want)))
        assert [tuple(r)[1:] for r in got] == want


@pytest.mark.parametrize("size", [50, 10**9])
def test_mixed_records(spark, split_at, tmp_path, size):
    rng = random.Random(8)
    lines = some_lines(rng, 60)
    path = tmp_path / "mixed.txt"
    path.write_text("\r\n".join(lines) + "\r\n")
    split_at(size)
    got = {r["rec_no"]: r for r in readers.read_mixed(spark, [str(path)]).collect()}
    for n, (kind, header, seq, qual) in enumerate(records_of(lines)):
        f = header.split("\t")
        if kind == "line" and f[0] == "M":
            assert (n in got) == (f[-1] == "1")
            if n in got:
                assert (got[n]["kind"], got[n]["seq"], got[n]["qual"], got[n]["offset"]) == ("qseq", f[8], f[9], 64)
        elif kind == "line":
            assert (n in got) == (f[1] not in ("256", "512"))
            if n in got:
                back = f[1] in ("16", "145")
                assert got[n]["seq"] == (f[9][::-1].translate(str.maketrans("ACGT", "TGCA")) if back else f[9])
                assert got[n]["id"] == f[0] + {"65": "/1", "145": "/2"}.get(f[1], "")
        elif kind == "@":
            assert (got[n]["kind"], got[n]["id"], got[n]["seq"], got[n]["qual"]) == ("fastq", header[1:].split(" ")[0] + "/1", seq, qual)
        else:
            assert (got[n]["kind"], got[n]["id"], got[n]["seq"], got[n]["qual"]) == ("fasta", header[1:].split(" ")[0], seq, None)


def test_stray_line_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("only\tthree\tfields\n")
    with pytest.raises(Exception, match="neither a header nor 11 fields"):
        readers.read_mixed(spark, [str(tmp_path / "x.txt")]).collect()


def test_fastq_over_splits(spark, split_at, tmp_path):
    """Equal over one split and over many; no line goes through an exchange."""
    rng = random.Random(1)
    rows = [(f"r{i}", "c" * rng.randrange(3), "A" * (n := rng.randrange(1, 40)), rng.choice("@>#+I") * n) for i in range(200)]
    path = tmp_path / "r.fq"
    path.write_text("".join(f"@{i}{' ' + c if c else ''}\n{s}\n+\n{q}\n" for i, c, s, q in rows) + "\n")
    want = [(n, *r) for n, r in enumerate(rows)]
    for size in (10**9, 300):
        split_at(size)
        found = readers.read_fastq(spark, [str(path)])
        assert [tuple(r) for r in found.orderBy("rec_no").collect()] == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "")
        lines = readers.read_lines(spark, [str(path)])
        assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(801))
        assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    path.write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="without a quality line"):
        readers.read_fastq(spark, [str(path)]).collect()


def test_many_files_in_one_scan(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}.fa").write_text(f">a{i}\nAC\nGT\n>b{i} note\nTT\n")
    paths = [str(tmp_path / f"f{i}.fa") for i in range(299, -1, -1)]
    found = readers.read_fasta(spark, paths)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert [(r["id"], r["seq"]) for r in found.orderBy("rec_no").collect()] == [x for i in range(299, -1, -1) for x in ((f"a{i}", "ACGT"), (f"b{i}", "TT"))]
    assert [r["rec_no"] for r in found.orderBy("rec_no").collect()] == list(range(600))


def test_each_file_is_sniffed(spark, tmp_path):
    (tmp_path / "a.txt").write_text(">a\nAC\n")
    (tmp_path / "b.txt").write_text("@b\nGG\n+\nII\n@c\nGT\n+\nII\n")
    (tmp_path / "c.txt").write_text("@HD\tVN:1\n" + "\t".join(["s", "0", "c", "1", "9", "2M", "*", "0", "0", "TT", "II"]) + "\n")
    (tmp_path / "list").write_text("\n".join(str(tmp_path / f"{n}.txt") for n in "bac") + "\n")
    got = readers.read_sequences(spark, [f"@{tmp_path / 'list'}", str(tmp_path / "a.txt")]).orderBy("rec_no").collect()
    assert [(r["rec_no"], r["id"], r["seq"]) for r in got] == [(0, "b", "GG"), (1, "c", "GT"), (2, "a", "AC"), (3, "s", "TT"), (4, "a", "AC")]


def test_colour_reads(spark):
    """Primers go, their first colour with them; masked ends and case of colour reads stay."""
    rows = spark.createDataFrame([("a", "T0123", "III"), ("b", "aCGTa", "IIIII"), ("c", "ACNNT", "ABCDE")], "id string, seq string, qual string")
    got = {r["id"]: (r["anchor"], r["seq"], r["qual"]) for r in readers.clean(rows).collect()}
    assert got["a"][:2] == ("T", "123") and got["b"][1:] == ("CGT", "III") and got["c"][1:] == ("ACNNT", "ABCDE")


def test_composition_is_the_walk():
    import numpy as np

    rng = random.Random(0)
    for machine in records.MACHINES:
        step, begin = records._tables(machine)
        for n in (0, 1, 2, 3, 7, 64, 101):
            classes = np.array([rng.randrange(6) for _ in range(n)], np.int64)
            to, count = records.composed(classes, machine)
            for s in range(6):
                state, begun = s, 0
                for c in classes:
                    begun += begin[state, c]
                    state = step[state, c]
                assert (to[s], count[s]) == (state, begun)


def test_records_of_four_lines_at_once():
    """Whole records of a batch come out as those cut line by line, wherever a batch or a split begins."""
    import pyarrow as pa

    from kmerloom.sources import records as R

    lines = [x for i in range(9) for x in (f"@r{i}\r" if i % 2 else f">r{i}", "AC" * i, "+", "@I" * i + "\r")]
    for state, before in ((R.BETWEEN, 0), (R.BASES, 1), (R.PLUS, 2), (R.QUALITY, 3)):
        for ends in ([36], [5, 36], [1, 2, 3, 17, 30, 36], [33, 34]):
            one, many = R._Cut("fastq", state, 7), R._Cut("fastq", state, 7)
            want, got, at = [], [], before
            for end in ends:
                part = lines[at:end]
                want += list(one.add(part, [R.AT] * len(part)))
                got += [tuple(r.values()) for b in R._fours(many, pa.array(part, pa.string())) for r in b.to_pylist()]
                at = max(at, end)
            assert got == want and list(many.close(False)) == list(one.close(False)) and (many.number, many.state) == (one.number, one.state)


def test_mixed_records_at_once():
    """Whole records of all kinds come out of a batch as those cut line by line, wherever a batch or a split begins; ``led`` ends where the walk does."""
    import numpy as np
    import pyarrow as pa

    from kmerloom.sources import records as R

    rng = random.Random(5)
    sort = lambda x: R.BLANK if not x else R.GREATER if x[0] == ">" else R.HASH if x[0] == "#" else R.SAM_HEADER if x.startswith("@HD\t") else R.AT if x[0] == "@" else R.OTHER
    step, begin = R._tables("any")
    for turn in range(300):
        lines = some_lines(rng, 12)[rng.randrange(3) :]
        classes = np.array([sort(x) for x in lines], np.int64)
        state = rng.randrange(6)
        one, many = R._Cut("any", state, 7), R._Cut("any", state, 7)
        cuts = sorted({0, len(lines), *(rng.randrange(len(lines) + 1) for _ in range(turn % 5))})
        got = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            got += [tuple(r.values()) for part in R._anys(many, pa.array(lines[a:b], pa.string()), classes[a:b]) for r in part.to_pylist()]
        assert got == list(one.add(lines, classes.tolist()))
        assert list(many.close(False)) == list(one.close(False)) and (many.number, many.state) == (one.number, one.state)
        n, at = 0, state
        while at != R.BETWEEN and n < len(lines) and not begin[at, classes[n]]:
            at, n = step[at, classes[n]], n + 1
        assert R.led(classes, state, "any")[0] == n


def test_lines_sent_again(spark, split_at, tmp_path, monkeypatch):
    """Only lines that end a record over an edge of splits go through Python once more; before, all lines did."""
    path = tmp_path / "m.txt"
    path.write_text("".join(f"@r{i}\nACGT\n+\nIIII\n>f{i}\nAC\nGT\n#\n" for i in range(400)))
    split_at(1000)
    sent = spark.sparkContext.accumulator(0)

    def counting(machine):
        def go(batches):
            for batch in batches:
                sent.add(batch.num_rows)
                yield from inner(iter([batch]))

        inner = heads(machine)
        return go

    heads = records._heads
    monkeypatch.setattr(records, "_heads", counting)
    assert records.cut_records(spark, [str(path)]).count() == 800
    assert 0 < sent.value < 4 * 13
