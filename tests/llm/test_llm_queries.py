"""The registered queries with SQL against DuckDB on whole tables of the smallest size, and the pipeline on a small folder."""

import duckdb
import pytest
from pyspark.sql import functions as F

from antecede.llm import common, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = registry.QUERIES[name](spark, FOLDER)
    want = con.execute(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.saved(stage(spark, docs, FOLDER))
        if name != "packing":
            assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
            held[name] = (before.count(), docs.count())
    assert held["toxicity"][1] >= 0.8 * held["toxicity"][0] and held["language"][0] == held["language"][1]
    assert held["near_duplicates"][1] < held["near_duplicates"][0] and held["decontamination"][1] < held["decontamination"][0]
    assert docs.agg(F.count_distinct("doc_id")).first()[0] == held["decontamination"][1]


def test_pipeline_keeps_one_of_each_and_odd_rows(spark):
    import corpus_pipeline

    text = "a text of more than five words that is held twice"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " ", "en", "s", 1), (3, None, None, None, None), (None, text, "en", "s", 1), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.deduplicated(spark, docs, FOLDER)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert {r.doc_id for r in corpus_pipeline.identified(spark, docs, FOLDER).collect()} == {1, 2, None}


def test_pipeline_with_long_texts_ties_and_odd_columns(spark):
    """Each stage by itself: very long texts, ties, repeated rows, and columns whose names hold dots or clash with inner ones."""
    import corpus_pipeline

    base = " ".join(f"word{k} of the text" for k in range(60))
    rows = [(1, "the long and the short of it " * 40_000), (2, base), (3, base + " more"), (3, base + " more"), (4, base), (5, "x" * 500_000), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1 AS n_chars", "doc_id + 7 AS `a.b`", "text AS hub", "1L AS gone", "2 AS component")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        kept = sorted(out.select("doc_id", "`a.b`").collect())
        assert all(b == a + 7 for a, b in kept), name
        if name == "near_duplicates":
            assert [a for a, _ in kept] == [1, 2, 5, 6]
        elif name in ("toxicity", "decontamination"):
            assert [a for a, _ in kept] == [1, 2, 3, 3, 4, 5, 6], name
    pieces = corpus_pipeline.packed(spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == 6 and pieces.where("doc_id = 1").count() > 100
