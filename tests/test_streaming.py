from kmerloom.streaming.kmers import stream_counts, stream_reads


def test_counts_grow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [(">a\nACG\nTA\n", {"ACGTA": 1}), (">b\nTACGT\n>c x\nACNGT\n", {"ACGTA": 2}), ("@r\nACGTA\n+\nCCCCC\n@s\nAAAAA\n+\nCCCCC\n", {"ACGTA": 3, "AAAAA": 1})]
    for i, (text, want) in enumerate(files):
        (tmp_path / "in" / f"{i}.txt").write_text(text)
        query = (
            stream_counts(stream_reads(spark, str(tmp_path / "in")), 5)
            .writeStream.format("memory").queryName(f"counts{i}").outputMode("complete")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert {r.canon: r.n for r in spark.table(f"counts{i}").collect()} == want
