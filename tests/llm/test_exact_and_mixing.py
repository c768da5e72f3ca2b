from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from attestor.llm import exact_dedup, mixing

ROWS = [
    (1, "a b c", "s1"), (2, "a b c", "s2"), (7, "a b c", None), (3, "", "s1"), (4, None, "s1"), (5, "a b c ", "s3"),
    (6, "ä\n", "s3"), (6, "ä\n", "s3"), (None, "x y", "s2"), (8, "x y", "s2"), (None, "only", "s2"), (9, "w " * 5000, "s1"), (10, "w " * 5000, "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    # Extra columns with names that the operators use themselves.
    return frame.withColumns({c: F.lit(1) for c in ("key", "digest", "kept", "keep_id", "group_size", "body", "size", "copies", "node")})


def expected_groups(rows):
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[text or ""].append(key)
    out = []
    for key, text, _ in rows:
        members = groups[text or ""]
        keep = max((k for k in members if k is not None), default=None)
        out.append((key, keep, len(members), key == keep, sha256((text or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("salts", [1, 5])
def test_groups_against_brute_force(docs, salts):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs, salts=salts).collect())
    assert got == expected_groups(ROWS)


@pytest.mark.parametrize("digest", [lambda t: F.lit("same"), lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)])
def test_colliding_digests_are_told_apart_by_content(docs, digest):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs, digest=digest).collect())
    assert got == expected_groups(ROWS)
    kept = exact_dedup.drop_exact_copies(docs, digest=digest)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t, _ in ROWS})


def test_one_row_a_text_stays(docs):
    kept = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in kept) == sorted(
        {(t or "", max([k or 0 for k, x, _ in ROWS if (x or "") == (t or "")])) for _, t, _ in ROWS}
    )


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0
    assert mixing.mix(none).count() == mixing.repeat_by_copies(none).count() == 0


def shared_out(sizes, volume=1.5, cap=2.0, weights=(5, 2, 1)):
    """Sharing, stopping and sharing the excess anew, one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), volume * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > cap * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
        if not free:
            return target


def test_targets_against_rounds_of_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "Z": 7, "é": 300, None: 90, "d": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(shared_out(sizes))


def test_mix_meets_targets_and_is_repeatable(spark):
    rows = []
    for i in range(3000):
        source = ["s0", "s1", "s2", "s3", None][0 if i % 3 == 0 else i % 5]
        # A third of all rows has one source, many of them one size.
        rows.append((i, "w " * (50 if i % 3 == 0 and i % 2 else 1 + i * 7919 % 400), source))
    rows += [(3000, None, "s1"), (3001, "", "s1"), (5, rows[5][1], rows[5][2]), (3002, "w " * 20000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rate", F.lit(0))
    plan = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in plan) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    source = {k: s for k, _, s in rows}
    sizes, got, targets, largest = Counter(), Counter(), {}, Counter()
    for r in plan:
        s = source[r.doc_id]
        sizes[s] += r["size"]
        got[s] += r.taken
        targets[s] = r.target
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    assert targets == pytest.approx(shared_out(sizes))
    for s in sizes:
        assert abs(got[s] - targets[s]) <= 1.5 * largest[s] + 1, s
    # Rates are exponential in the size below the cap: equal log-rate per word in a source.
    slopes = defaultdict(list)
    import math
    for r in plan:
        if 20 < r["size"] and 0.01 < r.rate < 1.999:
            slopes[source[r.doc_id]].append(math.log(r.rate) / r["size"])
    assert slopes and all(max(v) - min(v) < 1e-4 for v in slopes.values())
    mixed = mixing.repeat_by_copies(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    wanted = Counter()
    for r in plan:
        wanted[r.doc_id] += r.copies
    assert counts == +wanted
