"""Quality rules: fixed rules over document statistics, then gradient-boosted trees.

The trees are fitted here on labelled documents (a bounded sample of their statistics, not of
their texts), with histogram splits and monotonic constraints, and flattened into numpy node
arrays: every document of a batch walks all trees at once, level by level.

A null text counts as empty. Without labels of both kinds the trees say "keep" and the fixed
rules decide alone. Repeated rows are scored one by one with equal results; other columns pass
through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import bounded_batches, hashed_sample, text_bytes

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
STOPS = b".!?,;:"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "upper_share", "digit_share", "stop_share", "shout_share", "top_word_share", "words_per_line",
    "stutter_share",
)
# +1: a larger value never lowers the score, -1: never raises it, 0: free.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, -1, 0, 0, -1)

# The bound on labelled documents whose statistics are collected for fitting.
FIT_ROWS = 20_000
KEEP_SCORE = 0.5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # A 64-bit mix of the window rules repeats out; only then are windows compared exactly.
    mixed = np.zeros(count, np.uint64)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(31)
    for k in range(window):
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + spread[k : k + count]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(counts[inverse] > 1)
    rows = ids[maybe[:, None] + np.arange(window)]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = maybe[counts[inverse.ravel()] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(data: bytes) -> tuple[list[int], list[float]]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and FEATURES."""
    words = data.split()
    n = len(words)
    dense = data.translate(None, WHITE)
    chars = len(dense.translate(None, CONTINUATION))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    size, many = max(len(dense), 1), max(n, 1)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    less = lambda drop: (len(dense) - len(dense.translate(None, drop))) / size
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return [n, chars, symbols, dup_lines, repeats], [
        float(np.log1p(n)), chars / many, symbols / size, dup_lines / max(len(lines), 1), repeats / many,
        len(counts) / many, less(UPPER), less(DIGITS), less(STOPS), less(b"!"),
        max(counts.values(), default=0) / many, n / max(len(lines), 1), stutter / many,
    ]


def base_failed(base: list[int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]


# --- trees -----------------------------------------------------------------------------


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points at itself, so every walk takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality per row of statistics."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(down, self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.prior + self.value[at].sum(1))))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Forest:
    """Second-order boosting of the logistic loss on binned statistics.

    A split on a constrained feature must order its two leaf values, and the middle between them
    bounds all later leaves on either side, so the whole forest is monotone in that feature.
    """
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.999
    prior = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(y), prior)

        def leaf(v: float) -> int:
            feature.append(0)
            threshold.append(0.0)
            left.append(len(value))
            right.append(len(value))
            value.append(v)
            return len(value) - 1

        def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray, out: np.ndarray) -> int:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            here = float(np.clip(-total_g / (total_h + ridge), low, high))
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth and len(rows) > 1 else ():
                width = len(cuts[f]) + 1
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], width))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], width))[:-1]
                if not len(gs):
                    continue
                a = np.clip(-gs / (hs + ridge), low, high)
                b = np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
                gain = -(gs * a + 0.5 * (hs + ridge) * a * a) - ((total_g - gs) * b + 0.5 * (total_h - hs + ridge) * b * b)
                gain += total_g * here + 0.5 * (total_h + ridge) * here * here
                ok = (hs >= least * 0.1) & (total_h - hs >= least * 0.1)
                if monotone[f]:
                    ok &= (b - a) * monotone[f] >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, float(a[k]), float(b[k])))
            if best[1] is None:
                out[rows] = here * rate
                return leaf(here * rate)
            f, k, a, b = best[1]
            me = leaf(0.0)
            middle = (a + b) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
            below = binned[rows, f] <= k
            lo = grow(rows[below], level + 1, *bounds[0], g, h, out)
            hi = grow(rows[~below], level + 1, *bounds[1], g, h, out)
            feature[me], threshold[me], left[me], right[me] = f, float(cuts[f][k]), lo, hi
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            out = np.zeros(len(y))
            roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0, p - y, p * (1 - p), out))
            margin += out
    if not roots:
        feature, threshold, left, right, value, roots = [0], [0.0], [0], [0], [0.0], [0]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, prior)


# --- Spark side --------------------------------------------------------------------------


def _statistics_batches(batches):
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(0)]
        arrays = [pa.array([base for base, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [*batch.schema.names[1:], "base", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Forest:
    """Fit on about ``fit_rows`` labelled documents at most, chosen by a hash of their key.

    The tasks compute the statistics; the driver collects those few numbers per document.
    """
    bounded_batches(docs.sparkSession)
    named = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    known = named.groupBy("key").agg(F.max("y").alias("y"))
    known = hashed_sample(known, "key", fit_rows)
    texts = docs.select(text_bytes(text).alias("text"), F.col(key).alias("key")).join(F.broadcast(known), "key").select("text", "y")
    schema = "y int, base array<bigint>, x array<double>"
    sample = texts.mapInArrow(_statistics_batches, schema).select("y", "x").toArrow()
    y = np.array(sample.column("y").to_pylist(), float)
    x = np.array(sample.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    # The order of collected rows is not fixed; the fit must not depend on it.
    order = np.lexsort((*x.T, y)) if len(y) else []
    return fit_forest(x[order], y[order])


def base_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, the base counts and base_failed, which need no model."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(text_bytes(text).alias("text"), F.col(key).alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_statistics_batches, f"key {kind}, base array<bigint>, x array<double>")
    names = [f.name for f in VERDICT.fields[:5]]
    counts = found.select(F.col("key").alias(key), *[F.col("base")[i].alias(name) for i, name in enumerate(names)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


BASE_SQL = f"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (SELECT id, i, w[i:i + {WINDOW - 1}] AS run FROM (SELECT id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM t)),
repeated AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, run) > 1),
covered AS (SELECT id, count(DISTINCT i + j) AS n FROM repeated, range({WINDOW}) AS steps(j) GROUP BY id),
lines AS (SELECT id, unnest(string_split(x, chr(10))) AS line FROM t),
dups AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
counts AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM t LEFT JOIN dups USING (id) LEFT JOIN covered USING (id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts
"""


VERDICT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def _judge(forest: Forest, keep_score: float, texts) -> list[np.ndarray]:
    rows = [statistics(t.as_py()) for t in texts]
    base = np.array([b for b, _ in rows], np.int64).reshape(len(rows), 5)
    score = forest.score(np.array([x for _, x in rows], float).reshape(len(rows), len(FEATURES)))
    failed = np.array([base_failed(b) for b, _ in rows], bool)
    return [*base.T, failed, score, ~failed & (score >= keep_score)]


def judge_quality(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """Per document: key, the base counts, base_failed, score and kept."""
    rows = docs.select(text_bytes(text).alias("text"), F.col(key).alias("key"))
    names = [f.name for f in VERDICT]

    def run(batches):
        for batch in batches:
            found = _judge(forest, keep_score, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, found)], ["key", *names])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *VERDICT])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, forest: Forest, text: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """The documents that pass, with their own columns only."""
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
    rows = docs.select(text_bytes(text).alias("text"), body)

    def run(batches):
        for batch in batches:
            kept = _judge(forest, keep_score, batch.column(0))[-1]
            yield batch.select([1]).filter(pa.array(kept))

    return rows.mapInArrow(run, T.StructType([rows.schema["body"]])).select("body.*")
