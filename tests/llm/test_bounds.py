"""Samples stay within their bounds when ids and rows repeat; stages keep columns of any name."""

from collections import Counter

from trackweave.llm import language_id, quality, simhash


def test_quality_sample_is_bounded_after_the_join(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "repeat(concat('word', id, ' '), 30) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y, *a, **b: seen.append((len(x), len(y))))
    quality.fit_quality(docs, labels, max_rows=1500)
    assert seen == [(1500, 1500)]


def test_language_sample_counts_repeated_rows_once(spark, monkeypatch):
    texts = [(1, "same text again", "en")] * 500 + [(i, f"a text {i}", "en") for i in range(2, 200)] + [(300, "ein Text", "de")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id.ContextTrees, "fit", classmethod(lambda cls, texts, order: seen.append(texts)))
    language_id.fit_languages(docs, max_rows=60)
    assert {k: len(v) for k, v in seen[0].items()} == {"en": 30, "de": 1}
    assert all(n == 1 for n in Counter(seen[0]["en"]).values())


def test_near_duplicates_with_clashing_names(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, line, 5, 6, 7, 8), (2, line, 1, 2, 3, 4)], "doc_id long, text string, id_ int, key_ int, key_here int, row int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, line, 5, 6, 7, 8)]
