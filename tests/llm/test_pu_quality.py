import numpy as np
from pyspark.sql import functions as F

from attestor.llm import pu_quality as Q
from attestor.llm.toxicity import remainder


def test_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, 9), rng.normal(-0.5, 1, 13)
    good, bad = Q.risk(pos, unl, 0.1)
    loss = lambda v: np.log1p(np.exp(-v))
    assert np.isclose(good, 0.1 * loss(pos).mean()) and np.isclose(bad, loss(-unl).mean() - 0.1 * loss(-pos).mean()) and bad > 0
    for sign, prior in ((1, 0.1), (-1, 0.95)):
        p, u = (pos, unl) if sign > 0 else (pos + 4, unl - 6)
        total = lambda a, b: sum(Q.risk(a, b, prior)) if sign > 0 else -Q.risk(a, b, prior)[1]
        assert (Q.risk(p, u, prior)[1] < 0) == (sign < 0)
        for which, slope in enumerate(Q.slopes(p, u, prior)):
            for i in range(len(slope)):
                step = [p.copy(), u.copy()]
                step[which][i] += 1e-6
                assert np.isclose((total(*step) - total(p, u)) / 1e-6, slope[i], atol=1e-5)


def test_prior_and_hidden_negatives():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.7):
        hidden = rng.random(4000) < share
        unl = rng.normal(0, 1, (4000, Q.FEATURES))
        # As in texts, what tells good from bad shows in several statistics at once.
        unl[hidden, :8] += 3
        pos = rng.normal(0, 1, (1500, Q.FEATURES))
        pos[:, :8] += 3
        model = Q.fit(pos, unl)
        assert abs(model.prior - share) < 0.08
        assert ((model.score(unl) > 0.5) == hidden).mean() > 0.97


def test_statistics_of_odd_texts():
    for data in (b"", b" \n ", b"x", b"a" * 10_000, b"|" * 5000, ("é ß " * 3000).encode(), b"\n".join([b"line"] * 4000)):
        x = Q.describe(data)
        assert x.shape == (Q.FEATURES,) and np.isfinite(x).all()
    assert (Q.describe(b"") == 0).all() and (Q.describe(b" \n") == 0).all()
    # Blocks make a text comparable to a hundred of it.
    plain = " ".join(f"word{i % 41} of" for i in range(400)).encode()
    assert np.abs(Q.describe(plain)[: Q.BLOCK_WIDTH] - Q.describe(b" ".join([plain] * 100))[: Q.BLOCK_WIDTH]).max() < 0.02


def test_held_out_accuracy_with_positives_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = remainder("doc_id", 5)
    model = Q.train_pu(docs, labels.where("quality = 1"), fold != 0)
    assert 0.75 < model.prior < 0.95
    rows = Q.score_quality(docs, model).where(fold == 0).join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(bad) > 5 and min(good) > max(bad)
    assert all(r.predicted == r.quality for r in rows)
    # Labels of the held-out fold have no part in the model.
    flipped = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(Q.train_pu(docs, flipped, fold != 0).w1, model.w1)


def test_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, good + " x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"x": F.lit(1), "score": F.lit("a"), "trusted": F.lit(3)})
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (2, 0)], "doc_id bigint, quality int")
    for known in (none, labels):
        out = Q.score_quality(docs, Q.train_pu(docs, known, F.lit(True))).collect()
        assert [r.doc_id for r in out] == [1, 2, 3, 3, None, 4] and all(0 <= r.score <= 1 for r in out)
        assert out[2] == out[3] and out[0].score == out[1].score and out[2].score == out[4].score
    assert {r.score for r in Q.score_quality(docs, Q.train_pu(docs, none, F.lit(True))).collect()} == {0.5}
    assert Q.score_quality(docs.limit(0), Q.train_pu(docs.limit(0), labels, F.lit(True))).count() == 0
