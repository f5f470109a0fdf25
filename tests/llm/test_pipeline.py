"""The pipeline's stages on a small table: kept rows, columns and effects."""

import corpus_pipeline as C

from .texts import PASSAGE, prose


def test_stages(spark, tmp_path):
    clean = [prose(80) for _ in range(12)]
    edited = clean[0].split()
    edited[3] = "changed"
    texts = [*clean, clean[0], " ".join(edited), "too short", None, prose(30) + " " + PASSAGE, clean[1] + " write to me@mail.example.org", prose(60) + " write to you@mail.example.org"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.collect()})
        if name != "byte_bpe":
            assert docs.columns == C.COLUMNS
        if name == "pii":
            assert "[EMAIL]" in docs.where("doc_id = 18").first().text and docs.where("text like '%@%'").count() == 0
    assert kept[0] == set(range(19)) - {14, 15}
    assert kept[1] == kept[0] - {12, 13, 17}
    assert kept[2] == kept[3] == kept[4] == kept[1] - {16}
    assert {tuple(r) for r in C.run(spark, str(tmp_path)).collect()} == {tuple(r) for r in docs.collect()}


def test_near_dedup_links_from_80_percent(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    edited = ["x" if i in (30, 60) else w for i, w in enumerate(words)]  # 86 of 106 shingles in common
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(edited), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in C.near_dedup(spark, docs, str(tmp_path)).collect()] == [1]


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    a, b = prose(80), prose(90)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, None), (6, None), (7, b + " " + PASSAGE), (7, prose(90))]
    docs = spark.createDataFrame([(i, t, None, None, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_id string")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    near = C.near_dedup(spark, docs, str(tmp_path))
    assert near.columns == C.COLUMNS
    assert key(near) == sorted([(1, a), (5, b), (None, a), (None, None), (6, None), rows[7], rows[8]], key=str)
    assert key(C.decontaminate(spark, docs, str(tmp_path))) == sorted(rows[:7] + rows[8:], key=str)
    assert C.mask(spark, docs, str(tmp_path)).count() == C.encode(spark, docs, str(tmp_path)).count() == len(rows)


def test_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
