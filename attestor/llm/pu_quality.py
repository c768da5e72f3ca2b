"""Quality by positive-unlabelled learning.

Only two kinds of text are needed: trusted positives, and unlabelled text in which good documents
occur with an unknown share, the class prior. The prior is estimated first: a classifier tells
positives from unlabelled text, and on texts held back from it the prior is the smallest ratio, over
all its thresholds, of the unlabelled share above to the positive share above (with an allowance
for chance). Then a small network is fitted to the non-negative unbiased risk

    prior * E_pos[loss(+)]  +  max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

where a batch whose second term falls below zero takes a step back instead, so that the network
cannot profit from calling known positives negative.

Texts are described by the characters and words of their blocks (about ``BLOCK`` bytes, cut at white
space): means over a text, and its best and worst blocks, so that a text that is bad in one half only
does not look average. Blocks make long texts comparable to short ones; they are measured in chunks.

Fitting takes about ``FIT_ROWS`` positives and as many unlabelled documents at most, chosen by a
hash of their key; only their statistics reach the driver. Every whole text is scored. A null text
counts as empty; empty texts have statistics like any other and are scored. Without positives or
unlabelled text every score is 0.5. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import bounded_batches, hashed_sample, text_bytes

BLOCK = 400
CHUNK = 1 << 20
FIT_ROWS = 12_000
HIDDEN = 24
PREDICT = 0.3

# Classes of bytes whose shares describe a block; bytes of other letters share the last class.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"|", b"#$%&*<>", b"\"'()-/")
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES):
    _CLASS_OF[list(_members)] = _i
# Of a block's words: distinct ones, equal neighbours, capitalised or upper-case ones, bytes a word.
WORD_SHARES = 4
BLOCK_WIDTH = len(CLASSES) + 1 + WORD_SHARES
# Mean, lowest and highest block, spread; then length, words a line, repeated lines, longest word.
FEATURES = 4 * BLOCK_WIDTH + 4


def chunks(data: bytes) -> Iterator[bytes]:
    """The text in pieces of bounded length, cut at blanks where there are any."""
    start = 0
    while start < len(data):
        stop = min(start + CHUNK, len(data))
        if stop < len(data):
            blank = data.rfind(b" ", start + CHUNK // 2, stop)
            stop = blank if blank > start else stop
        yield data[start:stop]
        start = stop


def block_rows(data: bytes) -> tuple[np.ndarray, int]:
    """One row of shares for every block of a chunk, and the chunk's longest word."""
    edges, words = [0], []
    while edges[-1] < len(data):
        start = edges[-1]
        blank = data.find(b" ", start + BLOCK) if len(data) - start >= 2 * BLOCK else -1
        stop = blank if 0 < blank < start + 2 * BLOCK else min(start + 2 * BLOCK, len(data))
        part = data[start:stop].split()
        n = max(len(part), 1)
        shouted = sum(w[:1].isupper() for w in part)
        words.append((len(set(part)) / n, sum(map(eq, part, part[1:])) / n, shouted / n, (stop - start) / n / 10, max(map(len, part), default=0)))
        edges.append(stop)
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kinds = _CLASS_OF[np.frombuffer(data, np.uint8)]
    width = len(CLASSES) + 1
    shares = np.bincount(owner * width + kinds, minlength=len(sizes) * width).reshape(-1, width) / sizes[:, None]
    by_word = np.array(words)
    return np.concatenate([shares, by_word[:, :WORD_SHARES]], 1), int(by_word[:, -1].max())


def describe(data: bytes) -> np.ndarray:
    """The statistics of one whole text."""
    if not data.strip():
        return np.zeros(FEATURES)
    rows, longest, filled, repeats = [], 0, 0, 0
    for chunk in chunks(data):
        found, widest = block_rows(chunk)
        rows.append(found)
        longest = max(longest, widest)
        lines = [line for line in map(bytes.strip, chunk.split(b"\n")) if line]
        filled += len(lines)
        repeats += len(lines) - len(set(lines))
    blocks = np.concatenate(rows)
    mean = blocks.mean(0)
    size = np.log1p(len(data))
    extra = [size / 10, np.log1p(len(data) / max(filled, 1)) / 10, repeats / max(filled, 1), np.log1p(longest) / 5]
    return np.concatenate([mean, blocks.min(0), blocks.max(0), blocks.std(0), extra])


# --- learning ------------------------------------------------------------------------------


@dataclass
class PuModel:
    """One hidden layer over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return forward(standardised(x, self.centre, self.scale), [self.w1, self.b1, self.w2, self.b2])[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -60, 60)))


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    # Bounded, so that one strange text cannot reach beyond what was learned.
    return np.clip((x - centre) / scale, -6.0, 6.0)


def forward(z: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = parts
    hidden = np.tanh(z @ w1 + b1)
    return hidden, hidden @ w2 + b2


def backward(z: np.ndarray, hidden: np.ndarray, slope: np.ndarray, w2: np.ndarray) -> list:
    """Gradients of the parts, given those of the logits."""
    inner = np.outer(slope, w2) * (1 - hidden * hidden)
    return [z.T @ inner, inner.sum(0), hidden.T @ slope, slope.sum()]


def risk(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk for logits: of positives, and of negatives (may be below zero)."""
    good = prior * np.logaddexp(0, -pos).mean()
    bad = np.logaddexp(0, unl).mean() - prior * np.logaddexp(0, pos).mean()
    return float(good), float(bad)


def slopes(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the non-negative risk by the logits of positives and of unlabelled texts."""
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    negative = -prior * sig(pos) / len(pos), sig(unl) / len(unl)
    if risk(pos, unl, prior)[1] < 0:
        # The unbiased estimate has become impossible: undo that part alone.
        return -negative[0], -negative[1]
    return prior * (sig(pos) - 1) / len(pos) + negative[0], negative[1]


def descend(pos: np.ndarray, unl: np.ndarray, slope_of, steps: int, batch: int = 1024, rate: float = 3e-3, decay: float = 1e-3) -> list:
    """Adaptive moment steps over shuffled batches; the seed is fixed."""
    rng = np.random.default_rng(7)
    width = pos.shape[1]
    parts = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0]
    mean, power = [0.0 * np.asarray(p) for p in parts], [0.0 * np.asarray(p) for p in parts]
    step, batches = 0, max(1, len(unl) // batch)
    for _ in range(max(1, steps // batches)):
        for p_rows, u_rows in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches)):
            if not len(p_rows) or not len(u_rows):
                continue
            step += 1
            (hp, gp), (hu, gu) = forward(pos[p_rows], parts), forward(unl[u_rows], parts)
            sp, su = slope_of(gp, gu)
            grads = [a + b for a, b in zip(backward(pos[p_rows], hp, sp, parts[2]), backward(unl[u_rows], hu, su, parts[2]))]
            for i, g in enumerate(grads):
                g = g + decay * parts[i]
                mean[i] = 0.9 * mean[i] + 0.1 * g
                power[i] = 0.999 * power[i] + 0.001 * g * g
                parts[i] = parts[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.999**step)) + 1e-8)
    return parts


def apart(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the plain log loss that tells positives from unlabelled texts."""
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    return (sig(pos) - 1) / len(pos), sig(unl) / len(unl)


def least_ratio(pos: np.ndarray, unl: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive shares above a threshold, for scores of unseen texts."""
    pos, unl = np.sort(pos), np.sort(unl)
    cuts = np.unique(pos)
    p_above = 1 - np.searchsorted(pos, cuts) / len(pos)
    u_above = 1 - np.searchsorted(unl, cuts) / len(unl)
    allowance = len(pos) ** -0.5 + len(unl) ** -0.5
    best = int(((u_above + allowance) / p_above).argmin())
    return float(np.clip(u_above[best] / p_above[best], 0.01, 0.99))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, steps: int = 300, turns: int = 3) -> float:
    """Share of positives in the unlabelled texts, from texts that the classifier did not see.

    The first classifier only tells the two samples apart. The next ones minimise the risk at the
    prior found so far, which ranks hidden negatives lower and so sharpens the estimate.
    """
    if min(len(pos), len(unl)) < 8:
        return 0.5
    prior, slope_of = 0.99, apart
    for _ in range(turns):
        parts = descend(pos[::2], unl[::2], slope_of, steps)
        prior = min(prior, least_ratio(forward(pos[1::2], parts)[1], forward(unl[1::2], parts)[1]))
        slope_of = lambda gp, gu, prior=prior: slopes(gp, gu, prior)
    return prior


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, steps: int = 500) -> PuModel:
    """Statistics of trusted positives and of unlabelled texts to a model."""
    if not len(pos) or not len(unl):
        return PuModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 0.5)
    # The order of collected rows is not fixed; the fit must not depend on it.
    pos, unl = pos[np.lexsort(pos.T)], unl[np.lexsort(unl.T)]
    rng = np.random.default_rng(11)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    centre, scale = unl.mean(0), unl.std(0) + 1e-3
    p, u = standardised(pos, centre, scale), standardised(unl, centre, scale)
    prior = estimate_prior(p, u) if prior is None else prior
    w1, b1, w2, b2 = descend(p, u, lambda gp, gu: slopes(gp, gu, prior), steps)
    return PuModel(centre, scale, w1, b1, w2, float(b2), prior)


# --- Spark side ----------------------------------------------------------------------------


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns and ``x``, the statistics of the text."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(text_bytes(text).alias("text"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [describe(value.as_py()) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], [*rest, "x"])

    return rows.mapInArrow(run, rows.select(*rest, F.lit(None).cast("array<double>").alias("x")).schema)


def train_pu(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, prior: float | None = None) -> PuModel:
    """Fit on documents for which ``learn`` (over the key column ``key``) holds.

    Positives are those with label 1; the unlabelled ones are drawn from all of them, whatever
    their label, which is not looked at.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.where(F.col(key).isNotNull()).where(learn).select(F.col(key).alias("key"), F.col(text).alias("text"))
    trusted = labels.where((F.col(label).cast("int") == 1) & F.col(key).isNotNull()).where(learn).select(F.col(key).alias("key")).distinct()
    trusted = F.broadcast(hashed_sample(trusted, "key", fit_rows)).withColumn("trusted", F.lit(True))
    n = usable.count()
    # Another hash than that of the positives: the two samples are drawn independently.
    drawn = F.pmod(F.xxhash64(F.col("key"), F.lit("unlabelled")), F.lit(2**32)) < int(min(1.0, fit_rows / max(n, 1)) * 2**32)
    sample = usable.join(trusted, "key", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"), drawn.alias("drawn"))
    found = described(sample.where("trusted or drawn")).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, FEATURES)
    masks = [np.array(found.column(c).to_pylist(), bool) for c in ("trusted", "drawn")]
    return fit(x[masks[0]], x[masks[1]], prior)


def score_quality(docs: DataFrame, model: PuModel, key: str = "doc_id", text: str = "text", threshold: float = PREDICT) -> DataFrame:
    """Per document: key, score, predicted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([describe(value.as_py()) for value in batch.column(1)]).reshape(len(batch), FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
