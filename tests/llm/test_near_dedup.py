import random
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import near_dedup as near


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def slow_components(rows, width, percent):
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        known = smallest.get(find(i))
        smallest[find(i)] = min((k for k in (known, key) if k is not None), default=None)
    return [(key, len(s), smallest[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    rows = []
    for group in range(6):
        base = [word() for _ in range(rng.randint(30, 150))]
        # One group is far longer than a short list; its copies reach from similar to not.
        for _ in range(90 if group == 0 else rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows += ["", None, " \n\t", "One", "one", "ONE two", "one  two\n", "É", "é", "x " * 30_000, "x " * 29_999]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = corpus(width)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "kept": F.lit(2), "sig": F.lit(3)})
    got = near.near_groups(docs, width=width).collect()
    expected = slow_components(rows, width, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    stay = near.drop_near_copies(docs, width=width)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(k for k, _, c in expected if k == c)


def test_null_keys_repeats_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (5, long + " end"), (5, long + " end"), (3, long + " other"), (None, "alone here now"), (None, None), (8, "alone here now")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_groups(docs, width=2).collect())
    # A pair of rows without a key and without a set stays for itself.
    assert got == Counter(slow_components(rows, 2, 80))
    assert near.near_groups(docs.limit(0)).count() == near.drop_near_copies(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, long), (None, long + " end")], "doc_id bigint, text string")
    assert {r.component_id for r in near.near_groups(nameless).collect()} == {None}


def test_match_floor_loses_hardly_any_pair():
    for percent in (60, 80, 95):
        p, least = (percent / 100) ** near.MINIMA, near.match_floor(percent)
        lost = sum(comb(near.COORDS, k) * p**k * (1 - p) ** (near.COORDS - k) for k in range(least))
        assert lost <= near.MISS and 1 <= least < near.COORDS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    one, two = near.signature(np.unique(pool[:2400])), near.signature(np.unique(pool[600:]))
    assert 0.1 < (one == two).mean() < 0.65  # 0.6 squared is 0.36


def test_rows_that_share_a_key_are_judged_by_their_texts(spark):
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, long, "a"), (2, long + " end", "b"), (2, other, "c"), (3, other + " end", "d"), (4, "", "e"), (4, "", "f"), (1, long, "a"), (1, long + " x", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string")
    stay = near.drop_near_copies(docs)
    got = Counter((r.doc_id, r.text.split(" ")[0]) for r in stay.collect())
    assert stay.columns == docs.columns
    # Key 2 is a copy with one text and the first of its group with the other; key 1 stays once.
    assert got == Counter({(1, "w0"): 1, (2, "v0"): 1, (4, ""): 2})


def test_blocks_are_bounded_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 300)
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near.near_groups(docs, width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(slow_components(rows, 2, 80))
