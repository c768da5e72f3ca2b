import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestor.llm import resampling as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def buckets(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_force(docs, targets, percent=5, least_words=20):
    raw, aim = Counter(b for _, t in docs for b in buckets(t)), Counter(b for t in targets for b in buckets(t))
    S, T = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (S + 10_000) / ((raw[b] + 1) * (T + 10_000))))
    rows = []
    for key, text in docs:
        own = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(spark, docs, targets, **how):
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "turn": F.lit(2)})
    right = spark.createDataFrame([(t,) for t in targets], "text string")
    out = R.resample(left, right, **how)
    return sorted(map(tuple, out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["Wörd", "a", "b2", "naïve", "THE", "the", "x-y", "z_z", "東京", "\xa0"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(300)]
    docs = [*enumerate(texts), (7, texts[7]), (None, texts[9]), (None, texts[11]), (400, None), (401, ""), (402, "one two")]
    targets = ["the naïve Wörd a b2", None, "東京 東京", ""]
    for percent in (5, 50, 100):
        got = found(spark, docs, targets, percent=percent)
        assert got == brute_force(docs, targets, percent)
        assert sum(r[4] is not None for r in got) == percent * sum(len(words_of(t)) >= 20 for _, t in docs) // 100


def test_ties_go_to_the_smaller_key(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(1000)], "key bigint, depth bigint")
    for wanted, expected in ((1, 0), (334, 0), (335, 1), (1000, 2)):
        assert R.least_reaching(rows, "depth", wanted) == expected
    assert R.least_reaching(rows, "key", 137) == 136
    wide = spark.createDataFrame([(v,) for v in (-(2**62), -5, 0, 3, 2**62, 2**63 - 1)], "v bigint")
    assert [R.least_reaching(wide, "v", n) for n in range(1, 7)] == [-(2**62), -5, 0, 3, 2**62, 2**63 - 1]


def test_repeated_rows_share_their_claims(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(1, text)] * 40 + [(2, "short")]
    got = found(spark, docs, ["w1 w2"])
    assert got == brute_force(docs, ["w1 w2"])
    assert sorted(r[4] for r in got if r[4]) == [1, 2]


def test_empty_tables(spark):
    assert found(spark, [], ["x"]) == []
    assert found(spark, [(1, "a b")], []) == brute_force([(1, "a b")], [])
    assert found(spark, [(1, None)], [None]) == brute_force([(1, None)], [None])


def test_chunks_of_a_long_text_give_the_same_features(monkeypatch):
    data = " ".join(f"Word{i % 97}, ü{i}" for i in range(2000)).encode()
    whole = list(R.hashed_features(data))
    monkeypatch.setattr(R, "CHUNK", 50)
    parts = list(R.hashed_features(data))
    assert len(parts) > 100 and sum(n for n, _ in parts) == whole[0][0]
    assert Counter(np.concatenate([b for _, b in parts]).tolist()) == Counter(whole[0][1].tolist()) == Counter(buckets(data.decode()))
