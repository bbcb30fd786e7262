import random

from reliefsignals.llm import quality


def corpus(spark, n):
    rng = random.Random(5)
    words = ["the", "and", "house", "river", "stone", "walks", "green", "of"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(rng.choice(words) + ("!!" if bad else "") for _ in range(40))
        rows.append((i, text, float(i)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(n, "", 0.0), (n + 1, None, 0.0), (None, "the river", 0.0)]
    labels += [(n + 5, 1, 0), (1, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark, 300)
    rows = quality.scores(spark, docs, labels).collect()
    assert len(rows) == 303
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert len(known) > 30 and all(r.predicted == (r.doc_id % 3 != 0) for r in known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = quality.of_quality(spark, docs, labels)
    assert kept.columns == docs.columns and 100 in {r.doc_id for r in kept.collect()}
    assert quality.scores(spark, docs.limit(0), labels).count() == 0


def test_without_labels_scores_are_neutral(spark):
    docs, labels = corpus(spark, 9)
    assert {r.score for r in quality.scores(spark, docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded(spark):
    labels = spark.range(5_000).withColumnRenamed("id", "doc_id")
    assert 800 < quality.sampled(labels, limit=1_000).count() < 1_200
    assert quality.sampled(labels, limit=5_000).count() == 5_000
