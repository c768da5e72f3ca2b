import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestor.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, top, longest=5):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= f[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((score, a, " ".join(p), l, r))
        scored.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, total[lang], s) for i, (s, a, p, l, r) in enumerate(scored[:top], 1)]
    return sorted(out)


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "ÉA", "x1", "new", "york", "a", "\x1cq", "\xa0"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "! "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(rng.choice(["en", "en", "de", None, "und"]), t) for t in texts]


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "a": F.lit("x"), "ids": F.lit(2), "doc_id": F.lit(None)})


def found(spark, rows, **how):
    return sorted(map(tuple, C.collocations(as_docs(spark, rows), **how).collect()))


def test_against_brute_force_in_one_part_and_in_many(spark):
    rows = random_rows(1, 120) + [("en", "new york city " * 40), ("en", "new york city " * 40), ("en", None), (None, None), ("de", "")]
    expected = brute_force(rows, 6, 50)
    assert len(expected) > 100 and any(len(e[2].split()) == 5 for e in expected)
    assert found(spark, rows, least=6, top=50) == expected
    assert found(spark, rows, least=6, top=50, part=7) == expected


def test_overlaps_and_covered_phrases(spark):
    # "a a a" holds "a a" twice; "b c" only occurs inside "b c d".
    rows = [("en", "a a a. b c d"), ("en", "b c d; z"), ("en", "B c D")]
    assert found(spark, rows, least=2) == brute_force(rows, 2, 2000)
    assert {r[2] for r in found(spark, rows, least=2)} == {"a a", "b c d"}


def test_long_text_is_cut_without_losing_phrases(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 64)
    data = ("new york is far, far away\n" * 50).encode()
    chunks = list(C.word_chunks(data))
    assert len(chunks) > 10
    monkeypatch.setattr(C, "CHUNK", 1 << 20)
    assert [w for c in chunks for w in c] == [w for c in C.word_chunks(data) for w in c]


def test_empty_and_rare(spark):
    assert found(spark, [("en", "one two three")]) == []
    assert C.collocations(as_docs(spark, [("en", "x")]).limit(0)).collect() == []
    assert found(spark, [("en", "a b")] * 99) == [] and len(found(spark, [("en", "a b")] * 100)) == 1


def test_trie_finds_every_phrase():
    rng = np.random.default_rng(5)
    for depth, letters in ((1, 5), (2, 9), (3, 4), (5, 300)):
        phrases = np.unique(rng.integers(1, letters * 7, (400, depth)), axis=0)
        trie = C.DoubleArray(phrases, np.arange(1, len(phrases) + 1))
        known = {tuple(p): i for i, p in enumerate(phrases.tolist(), 1)}
        ids = np.concatenate([np.zeros(1, np.int32), *(np.append(p, rng.integers(0, 3)) for p in phrases)]).astype(np.int32)
        at, state = trie.match(ids, len(ids))
        expected = {i: known[tuple(ids[i : i + depth])] for i in range(len(ids)) if tuple(ids[i : i + depth]) in known}
        assert dict(zip(at.tolist(), trie.value[state].tolist())) == expected and len(expected) >= len(phrases)


def test_large_products_are_exact(spark):
    # Beyond 64 bits: 1000 * a * n with a, n near 10**10, checked on the expression the operator uses.
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    row = spark.sql(f"SELECT (1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) AS s FROM VALUES (9876543210123, 98765432101234, 9876543210999, 9876543219999) AS t(a, n, l, r)").first()
    assert row.s == 1000 * 9876543210123 * 98765432101234 // (9876543210999 * 9876543219999)


def test_counts_are_handed_on_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(C, "HANDED", 1 << 10)
    keys = np.arange(1, 1001, dtype=np.int64) << 32
    for groups in (1, 7, 5000):
        batches = list(C.packed(keys, keys >> 32, groups))
        sizes = [sum(len(v) for name in ("keys", "counts") for v in b.column(name).to_pylist()) for b in batches]
        assert len(batches) > 10 and max(sizes) <= 1 << 10
        joined = lambda name: np.frombuffer(b"".join(v for b in batches for v in b.column(name).to_pylist()), np.int64)
        assert sorted(zip(joined("keys").tolist(), joined("counts").tolist())) == [(k << 32, k) for k in range(1, 1001)]
    assert list(C.packed(keys[:0], keys[:0], 3)) == []
