"""Stages of the corpus pipeline: defined cases, columns, and the whole run."""

import random

import pytest

import corpus_pipeline as pipeline

#: Extra columns bear names that the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_text string, n_spans int, _a bigint, fp string, _row string, score string"
rng = random.Random(8)


def words(letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "k", 7, 1, "f", "r", "c") for i, t, g in rows], SCHEMA)


LINE = "A line that stands in many of these documents, as it is."


def corpus():
    rows = [(i, f"{words('abcdefgh', 60)}\n{LINE}\n{words('abcdefgh', 20)}", "aa") for i in range(40)] + [(100 + i, words("stuvwxyz", 80), "bb") for i in range(40)]
    copy = rows[5][1]
    near = copy.replace(copy.split()[30], "changed")
    passage = " ".join(rows[7][1].split()[:45])
    return [*rows, (200, copy, "aa"), (201, near, "aa"), (202, f"{words('abcdefgh', 30)} {passage} {words('abcdefgh', 30)}", "aa"), (203, None, "aa"), (204, "", None), (205, "123 456 !", "aa"), (None, rows[6][1], "aa"), (100, rows[40][1], "bb")]


def test_stages(spark):
    docs = table(spark, corpus())
    known = pipeline.language_id(spark, docs, "").collect()
    assert {r.doc_id for r in known} == {r.doc_id for r in docs.collect()} - {203, 204, 205} and len(known) == docs.count() - 3
    lined = pipeline.line_dedup(spark, docs, "")
    got = {(r.doc_id, r.text) for r in lined.collect()}
    assert len(got) == docs.count() - 1 and sum(LINE in (t or "") for _, t in got) == 1 and (203, "") in got and (205, "123 456 !") in got
    assert all(r.n_chars == len(r.text) and (r.kept_text, r.n_spans, r._a, r.fp, r._row, r.score) == ("k", 7, 1, "f", "r", "c") for r in lined.collect())
    near = pipeline.near_dedup(spark, docs, "")
    ids = sorted(str(r.doc_id) for r in near.collect())
    assert ids == sorted(map(str, [*range(40), *range(100, 140), 202, 203, 205]))  # 203 and 204 have no words; None is a copy of 6
    cut = {r.doc_id: r for r in pipeline.substring_dedup(spark, near, "").collect()}
    assert set(map(str, cut)) == set(ids) and len(cut[202].text.split()) <= 61 and cut[7].text == near.filter("doc_id = 7").first().text and cut[203].text is None
    packed = pipeline.best_fit_packing(spark, near, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in near.collect()}
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert pipeline.best_fit_packing(spark, docs.limit(0), "").count() == 0


def test_run(spark, tmp_path):
    docs = table(spark, corpus())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = docs
    for _, stage in pipeline.STAGES:
        want = stage(spark, want, "")
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(pipeline.run(spark, str(tmp_path))) == key(want)


def test_many_labels(spark):
    """The most frequent labels are learned, all rows are predicted."""
    from kmerloom.llm.language import fit, predict

    rows = [(i, "der die das und nicht" if i % 2 else "the and of to with", "de" if i % 2 else "en") for i in range(60)] + [(100 + i, "the and of", f"dirt{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(frame, max_languages=2)
    assert model.languages == ["de", "en"]
    assert {r.lang_pred for r in predict(frame, model).filter("doc_id >= 100").collect()} == {"en"}
    assert fit(frame, most_rows=10).languages[:2] == ["de", "dirt0"]
