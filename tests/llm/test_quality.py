"""Trees on separable data, flattened traversal against a walk, held-out accuracy."""

import numpy as np

from tableops.llm import quality, queries
from tableops.llm.base import table

SF_DIR = "/root/testdata/sf0.01"


def walk(forest, row):
    total = forest.prior
    inner = forest.feature.shape[1]
    for f, t, leaves in zip(forest.feature, forest.threshold, forest.leaves, strict=True):
        node = 0
        while node < inner:
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        total += leaves[node - inner]
    return 1 / (1 + np.exp(-total))


def test_forest_learns_and_flat_arrays_agree():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(1500, len(quality.FEATURES)))
    labels = ((values[:, 0] > 0.3) ^ (values[:, 3] > 0)).astype(float)
    forest = quality.grow(values[:1000], labels[:1000], trees=40, depth=3)
    score = forest.score(values)
    assert ((score[1000:] > 0.5) == labels[1000:]).mean() > 0.95
    assert np.allclose(score[:50], [walk(forest, v) for v in values[:50]])
    assert ((score >= 0) & (score <= 1)).all()


def test_no_labels_or_only_one():
    nothing = quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert nothing.score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    ones = quality.grow(np.zeros((9, len(quality.FEATURES))), np.ones(9), trees=3)
    assert (ones.score(np.zeros((1, len(quality.FEATURES)))) > 0.9).all()


def test_held_out_accuracy(spark):
    scored = queries.op5_quality_classifier(spark, SF_DIR)
    docs = table(spark, SF_DIR, "documents")
    assert scored.count() == docs.count()
    labels = table(spark, SF_DIR, "labels")
    right, n = (
        scored.where("held_out").join(labels, "doc_id").selectExpr("avg(int(quality = predicted))", "count(*)").first()
    )
    assert n > 50 and right > 0.97


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "long text " * 40_000)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "capitals", "source": "score"})
    known = quality.statistics(docs, "doc_id")
    labels = spark.createDataFrame([(1, 1), (2, None), (7, 0)], "doc_id long, quality int")
    forest = quality.train(known, labels, trees=2)
    got = quality.classify(known, forest, "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(quality.statistics(make_docs([]), "doc_id"), forest, "doc_id").collect() == []


def test_the_bound_takes_rows_by_hash_not_by_order(spark, make_docs):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a, b = (
        quality.train(quality.statistics(make_docs(r), "doc_id"), labels, max_rows=20, trees=3)
        for r in (rows, rows[::-1])
    )
    assert np.array_equal(a.leaves, b.leaves)
