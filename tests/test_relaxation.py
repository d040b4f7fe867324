from factlake.plans.text_queries import ORACLES, filter_relaxation

from .oracle import agree, connect


def test_strict_hits_are_found_below_the_best_fifty(spark, tmp_path):
    """Sixty documents of another source score higher than the three that pass both filters."""
    texts = [(i, "rare word", "en", "src9") for i in range(60)] + [(i, "rare " + "other " * (20 + i), "fr", "src1") for i in range(100, 103)]
    texts += [(200, "rare " + "other " * 9, "de", "src1")] + [(i, "nothing of it", "en", "src1") for i in range(300, 500)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "rare word"), (2, "rare word")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in filter_relaxation(spark, str(tmp_path)).select("qid", "rank", "doc_id", "applied", "confidence").collect())
    assert got == [(1, i + 1, 100 + i, 0, "high") for i in range(3)] + [(2, i + 1, i, 2, "low") for i in range(5)]


def test_agrees_with_sql_over_all_hits(spark, sf):
    agree(spark, connect(sf), filter_relaxation, ORACLES["filter_relaxation"], sf)
