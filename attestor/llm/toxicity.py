"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is logistic in the weights of its distinct words; a word's weight is the sum of
the weights of itself and its beginnings, so that unseen forms of a known stem count. A document is
toxic unless all its sentences are harmless (noisy-or). A sentence without any offending word has the
bias as its logit, and its small chance is that of the document's background, which counts once and
not once a sentence: ``1 - P = (1 - p0) * prod((1 - p_i) / (1 - p0))``. Every further sentence can
only raise the score, and one without offending words leaves it as it is, however many there are.
Training sees document labels only and finds out by itself which sentences explain them; afterwards
the sentence scores locate offending sentences.

Fitting takes about ``FIT_DOCS`` labelled documents at most, and fewer if they would have more than
about ``FIT_CHARS`` characters together, chosen by hashes of their key whatever their lengths;
every whole text is fitted and scored. A null or empty text has no sentence and
score 0. Without labels of both kinds every score is 0. Only texts are inputs of a score; repeated
rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import bounded_batches, hashed_sample, whole_text

FIT_DOCS = 6_000
FIT_CHARS = 25_000_000
STEMS = (4, 5, 6)
CACHED_WORDS = 400_000

SENTENCE_END = re.compile(r"\n|(?<=[.!?])[ \t]+")
LEAST_WORDS = 4
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences as (start, end); those of few words are joined with what follows."""
    spans, start, at, held = [], 0, 0, 0
    for end in (*SENTENCE_END.finditer(text), None):
        stop = end.start() if end else len(text)
        held += text.count(" ", at, stop) + (stop > at)
        at = end.end() if end else stop
        if held >= LEAST_WORDS or end is None:
            if held:
                spans.append((start, stop))
            start, held = at, 0
    return spans


def sentence_words(text: str, spans: list[tuple[int, int]] | None = None) -> list[set[str]]:
    """Distinct lower-case words of every sentence."""
    return [set(WORD.findall(text[a:b].lower())) for a, b in (sentence_spans(text) if spans is None else spans)]


@dataclass
class ToxicModel:
    """Weights of features; ``weigh`` caches those of words."""

    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def weigh(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            get = self.weights.get
            value = self.known[word] = sum(get(f, 0.0) for f in features(word))
        return value

    def located(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans and logits of all sentences that have a word."""
        spans = sentence_spans(text)
        pairs = [(span, words) for span, words in zip(spans, sentence_words(text, spans)) if words]
        return [span for span, _ in pairs], np.array([self.bias + sum(map(self.weigh, words)) for _, words in pairs])

    def logits(self, text: str) -> np.ndarray:
        """Logits of all sentences that have a word."""
        weigh, bias = self.weigh, self.bias
        return np.array([bias + sum(map(weigh, words)) for words in sentence_words(text) if words])

    def offending(self, text: str) -> tuple[int, int] | None:
        """Start and end of the sentence with the highest logit, the first of equals."""
        spans = list(sentence_spans(text))
        logits = [sum(map(self.weigh, words)) for words in sentence_words(text, spans)]
        return max(zip(logits, spans), key=lambda x: x[0])[1] if spans else None


def softplus(x: np.ndarray | float) -> np.ndarray:
    return np.logaddexp(0.0, x)


def noisy_or(logits: np.ndarray, bias: float = -np.inf) -> float:
    """The chance that a document with these sentences is toxic, the background counted once.

    Without a background it is ``1 - prod(1 - p)``.
    """
    if not len(logits):
        return 0.0
    return float(-np.expm1(-softplus(bias) - (softplus(logits) - softplus(bias)).sum()))


def fit(texts: list[str], labels: list[int], rounds: int = 150, rate: float = 20.0, decay: float = 2e-4, least_docs: int = 3) -> ToxicModel:
    """Adaptive gradient steps on the noisy-or likelihood of document labels."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    y = np.array([labels[i] for i in order], bool)
    if not len(y) or y.all() or not y.any():
        return ToxicModel(-30.0, {})
    words: dict[str, int] = {}
    # Plain number arrays: a list of pairs would be many times the sample.
    cell_sentence, cell_word, owners, spread = array("l"), array("l"), array("l"), Counter()
    sentences = 0
    for d, i in enumerate(order):
        seen: set[str] = set()
        for part in sentence_words(texts[i]):
            if part:
                cell_word.extend(words.setdefault(w, len(words)) for w in sorted(part))
                cell_sentence.extend(repeat(sentences, len(part)))
                owners.append(d)
                seen |= part
                sentences += 1
        spread.update({f for w in seen for f in features(w)})
    names = [f for f, n in spread.items() if n >= least_docs]
    at = {f: k for k, f in enumerate(sorted(names))}
    word_of, feature_of = array("l"), array("l")
    for name, w in words.items():
        own = [at[f] for f in features(name) if f in at]
        feature_of.extend(own)
        word_of.extend(repeat(w, len(own)))
    pair_word, pair_feature = np.array(word_of, np.int64), np.array(feature_of, np.int64)
    sentence, word, owner = (np.array(x, np.int64) for x in (cell_sentence, cell_word, owners))
    lengths = np.bincount(owner, minlength=len(y))
    w, bias = np.zeros(len(at)), -8.0
    past_w, past_b = np.full(len(at), 1e-8), 1e-8
    weight_of = np.where(y, (~y).sum() / max(y.sum(), 1), 1.0) ** 0.5
    for _ in range(rounds):
        per_word = np.bincount(pair_word, w[pair_feature], len(words))
        z = bias + np.bincount(sentence, per_word[word], sentences)
        total = np.bincount(owner, softplus(z) - softplus(bias), len(y)) + softplus(bias)
        slope = np.where(y, -1.0 / np.expm1(np.minimum(total, 500.0)), 1.0) * weight_of / len(y)
        dz = slope[owner] / (1 + np.exp(-z))
        dword = np.bincount(word, dz[sentence], len(words))
        dw = np.bincount(pair_feature, dword[pair_word], len(at)) + decay * w / len(at)
        db = dz.sum() - ((lengths - 1) * slope).sum() / (1 + np.exp(-bias))
        past_w, past_b = past_w + dw * dw, past_b + db * db
        # Steps shrink with the fourth root: common stems learn faster than their rare forms.
        w = np.maximum(w - rate * dw / past_w**0.25, 0.0)
        bias = min(bias - 0.1 * db / np.sqrt(past_b), -6.0)
    return ToxicModel(float(bias), {f: float(w[k]) for f, k in at.items() if abs(w[k]) > 1e-4})


# --- Spark side --------------------------------------------------------------------------


def remainder(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the fold of a document (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def train_toxic(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> ToxicModel:
    """Fit on labelled documents for which ``learn`` (over the key column ``key``) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(learn)
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = hashed_sample(known, "key", fit_docs)
    texts = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    chars = texts.join(F.broadcast(known), "key").agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    if chars > fit_chars:
        # A second hash, independent of the first and of lengths, thins the sample out.
        known = known.where(F.pmod(F.xxhash64("key", F.lit("chars")), F.lit(2**32)) < int(fit_chars / chars * 2**32))
    sample = texts.join(F.broadcast(known), "key").select("text", "y").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("y").to_pylist())


def score_texts(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: key, score, predicted, n_offending, worst_start, worst_end, spans.

    Spans are (start, end, score, logit) of the offending sentences in order, those that score at
    least ``threshold`` by themselves; a document that only becomes toxic by several lesser ones
    has its highest-scoring sentence (the first of equals) instead, which ``n_offending`` does not
    count. Positions are code points, end exclusive. The worst is the highest span, the first of
    equals (null if there is none).
    """
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    bounded_batches(docs.sparkSession)
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, sizes = [], [], [0]
            starts, ends, values = array("q"), array("q"), array("d")
            for value in batch.column(1):
                spans, logits = model.located(value.as_py())
                score, at = noisy_or(logits, model.bias), np.flatnonzero(logits >= limit)
                scores.append(score)
                counts.append(len(at))
                if score >= threshold and not len(at):
                    at = [int(logits.argmax())]
                for i in at:
                    starts.append(spans[i][0])
                    ends.append(spans[i][1])
                    values.append(logits[i])
                sizes.append(len(starts))
            z = np.array(values, float)
            struct = pa.StructArray.from_arrays(
                [pa.array(np.array(starts, np.int64)), pa.array(np.array(ends, np.int64)), pa.array(np.exp(-np.logaddexp(0.0, -z))), pa.array(z)],
                ["start", "end", "score", "logit"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)],
                ["key", "score", "n_offending", "spans"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, score double, n_offending bigint, spans array<struct<start:bigint,end:bigint,score:double,logit:double>>"
    worst = F.array_max(F.transform("spans", lambda s: F.struct(s["logit"].alias("logit"), (-s["start"]).alias("place"), s["end"].alias("end"))))
    scored = rows.mapInArrow(run, schema).withColumn("worst", worst)
    return scored.select(
        F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending",
        (-F.col("worst.place")).alias("worst_start"), F.col("worst.end").alias("worst_end"), "spans",
    )
