import random

import numpy as np
from pyspark.sql import functions as F

from attestor.llm import quality


def slow_repeats(words, window=8):
    starts = {}
    for i in range(len(words) - window + 1):
        starts.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({j for at in starts.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [b"%d" % rng.randint(0, rng.choice([1, 3, 40])) for _ in range(rng.randint(0, 60))]
        if len(words) > 12 and rng.random() < 0.5:
            words += words[3:15]
        assert quality.repeated_words(words) == slow_repeats(words)


def test_base_counts():
    text = "a  b\tc\nx ü #*\n\nx ü #*\n  \n  \na b <|>"
    base, _ = quality.statistics(text.encode())
    words = text.replace(" ", "\x00").split()
    assert base[:4] == [len(words), sum(map(len, words)), 7, 1]
    assert quality.statistics(b"")[0] == [0, 0, 0, 0, 0]
    assert quality.base_failed([19, 0, 0, 0, 0]) and not quality.base_failed([20, 0, 0, 0, 6]) and quality.base_failed([20, 0, 0, 0, 7])


def test_forest_learns_and_is_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.FEATURES)))
    noise = rng.random(3000) < 0.05
    y = ((x[:, 2] < 0.5) & (x[:, 0] > 0.3)) ^ noise
    forest = quality.fit_forest(x, y.astype(float))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.93
    for feature, sign in enumerate(quality.MONOTONE):
        if sign:
            grid = np.repeat(x[:50], 40, axis=0)
            grid[:, feature] = np.tile(np.linspace(0, 1, 40), 50)
            steps = np.diff(forest.score(grid).reshape(50, 40), axis=1) * sign
            assert (steps >= -1e-9).all()


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((200, len(quality.FEATURES)))
    forest = quality.fit_forest(x, (x[:, 1] + x[:, 4] > 1).astype(float), trees=5)
    for row, score in zip(x, forest.score(x)):
        total = forest.prior
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    forest = quality.train_quality(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge_quality(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert sum(r.kept for r in judged if r.quality == 0) <= 2


def test_odd_rows_pass_through(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, good + " x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"body": F.lit(1), "base": F.lit(2), "score": F.lit(3)})
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    forest = quality.train_quality(docs, labels)
    judged = quality.judge_quality(docs, forest).collect()
    assert [(r.doc_id, r.kept) for r in judged] == [(1, False), (2, False), (3, True), (3, True), (None, True), (4, False)]
    kept = quality.keep_good(docs, forest)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.judge_quality(docs.limit(0), forest).count() == quality.keep_good(docs.limit(0), forest).count() == 0
