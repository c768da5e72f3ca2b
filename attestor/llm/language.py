"""Language identification of mixed texts.

Each word's script (a range of code points) narrows its candidate languages to those that use the
script. Every candidate scores the word by its letter n-grams; a Viterbi pass over the words, with
a penalty for switching, labels spans. The document's language is the one with most words.

Fitting takes about ``FIT_CHARS`` characters at most, an equal share of them for each language, so that
a rare one keeps its texts beside a frequent one. Texts are cut into chunks, and a hash of key and
chunk decides which take part, whatever the text's length. Every whole text is predicted: in chunks
where it is long, and the words of a batch's mixed texts in step. A text without letters, or null, is
``und`` with score 0, and so is every text if nothing could be learned. Only texts are inputs of a
prediction; repeated rows get equal results, ties go to the first language by name.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import bounded_batches, whole_text

FIT_CHARS = 20_000_000
FIT_CHUNK = 20_000
CHUNK = 1 << 20
CELLS = 1 << 21
GRAMS = (1, 2, 3)
SWITCH = 12.0
SCRIPT_SHARE = 0.02
CACHED_WORDS = 200_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")

# First code points of letter ranges and their scripts, from the Unicode block list (fixed values).
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
)
_STARTS = [start for start, _ in RANGES]


def script(word: str) -> str:
    """The script of a word's first letter."""
    return RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    framed = f"^{word}$"
    return [framed[i : i + n] for n in GRAMS for i in range(len(framed) - n + 1)] + [framed]


@dataclass
class LanguageModel:
    names: list[str]
    table: dict[str, int]  # n-grams and their rows
    logs: np.ndarray  # log-probabilities, a column per language; the last row is for unknown n-grams
    allowed: dict[str, np.ndarray]  # languages by script
    rows: dict[str, int] = field(default_factory=dict)
    store: np.ndarray | None = None

    @cached_property
    def by_code(self) -> tuple[np.ndarray, np.ndarray]:
        """The table's short n-grams as sorted numbers (21 bits a character), and their rows."""
        short = {g: row for g, row in self.table.items() if len(g) <= len(GRAMS)}
        codes = np.array([sum(ord(c) << 21 * i for i, c in enumerate(g)) for g in short], np.int64)
        order = np.argsort(codes)
        return codes[order], np.fromiter(short.values(), np.int64, len(short))[order]

    @cached_property
    def by_range(self) -> np.ndarray:
        """Languages that each range of code points allows."""
        every = np.ones(len(self.names), bool)
        return np.array([self.allowed.get(name, every) for _, name in RANGES])

    def learn(self, words: list[str]) -> None:
        """Log-likelihoods of words per language, averaged over n-gram orders; -1e6 where the script
        rules a language out (no language is ruled out if none uses the script)."""
        known, rows = self.by_code
        # One row more than the unknown one: n-grams that would cross into the next word add nothing.
        logs = np.concatenate([self.logs, np.zeros((1, len(self.names)))])
        unknown, nothing = len(self.logs) - 1, len(self.logs)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(letters))
        total = np.zeros((len(words), len(self.names)))
        code = np.zeros(len(letters), np.int64)
        for i in range(len(GRAMS)):
            code[: len(code) - i] |= letters[i:] << 21 * i
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            row = np.where(known[at] == code, rows[at], unknown) if len(known) else np.full(len(code), unknown)
            total += np.add.reduceat(logs[np.where(left > i, row, nothing)], starts, axis=0)
        get = self.table.get
        total += logs[np.fromiter((get(f"^{w}$", unknown) for w in words), np.int64, len(words))]
        fits = self.by_range[np.searchsorted(_STARTS, letters[starts + 1], side="right") - 1]
        first = len(self.rows)
        self.rows.update(zip(words, range(first, first + len(words))))
        self.store[first : first + len(words)] = np.where(fits, total / len(GRAMS), -1e6)

    def prepare(self, words: set[str]) -> None:
        """Have the scores of these words in the cache, which is emptied when it is full."""
        unseen = words.difference(self.rows)
        if self.store is None or len(self.rows) + len(unseen) > len(self.store):
            self.rows.clear()
            unseen = words
            self.store = np.empty((max(CACHED_WORDS, len(unseen)), len(self.names)))
        if unseen:
            self.learn(sorted(unseen))

    def matrix(self, words: list[str]) -> np.ndarray:
        """Scores of all words of a text, a row each; they must be prepared."""
        return self.store[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def steady(scores: np.ndarray, penalty: float) -> int | None:
    """The one label of a row of words, if no stretch of it gains half a penalty by any other.

    Staying with the label of the best total is optimal then, and prefix sums show that at once.
    """
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], 0)
    gain = np.concatenate([np.zeros((1, scores.shape[1])), gain])
    return best if (gain - np.minimum.accumulate(gain, 0)).max() <= penalty / 2 else None


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of a row of words: the sum of scores less a penalty per switch."""
    best = steady(scores, penalty)
    return np.full(len(scores), best) if best is not None else walk([scores], penalty)[0]


def walk(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The recursion for many texts at once, word by word; texts of similar length go together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    while order:
        longest, labels = texts[order[0]].shape
        n = max(1, CELLS // max(longest * labels, 1))
        # The first of a group is its longest; much shorter ones would mostly wait for it.
        n = max(1, sum(len(texts[i]) * 2 >= longest for i in order[:n]))
        group, order = order[:n], order[n:]
        for i, found in zip(group, _walk_group([texts[i] for i in group], penalty)):
            out[i] = found
    return out


def _walk_group(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Texts by falling length; those that have ended keep their totals."""
    if len(texts) < 4:
        return [_walk_one([scores], penalty)[0] for scores in texts]
    lengths = np.array([len(t) for t in texts])
    longest, labels = texts[0].shape
    scores = np.zeros((longest, len(texts), labels))
    for i, t in enumerate(texts):
        scores[: len(t), i] = t
    back = np.zeros((longest, len(texts), labels), np.uint8 if labels < 256 else np.uint16)
    own = np.arange(labels)
    running = np.searchsorted(-lengths, -np.arange(longest), side="left")
    total = scores[0].copy()
    for step in range(1, longest):
        m = running[step]
        some = total[:m]
        source = some.argmax(1)
        least = some.max(1)[:, None] - penalty
        stay = some >= least
        back[step, :m] = np.where(stay, own, source[:, None])
        total[:m] = np.where(stay, some, least) + scores[step, :m]
    label = total.argmax(1)
    found = np.zeros((longest, len(texts)), np.int64)
    for step in range(longest - 1, -1, -1):
        m = running[step]
        found[step, :m] = label[:m]
        label[:m] = back[step, np.arange(m), label[:m]] if step else label[:m]
    return [found[: len(t), i] for i, t in enumerate(texts)]


def _walk_one(blocks: Iterator[np.ndarray] | list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The recursion for one text whose scores come in blocks; labels by block.

    Only the back pointers of the whole text are held, a byte each.
    """
    total, pointers = None, []
    for block in blocks:
        labels = block.shape[1]
        back = bytearray() if labels < 256 else array("H")
        for row in block.tolist():
            if total is None:
                total = row
                back.extend(range(labels))
                continue
            top = max(total)
            source, least = total.index(top), top - penalty
            back.extend([k if t >= least else source for k, t in enumerate(total)])
            total = [(t if t >= least else least) + r for t, r in zip(total, row)]
        pointers.append(np.frombuffer(back, np.uint8 if labels < 256 else np.uint16).reshape(-1, labels))
    label = total.index(max(total))
    found = []
    for back in reversed(pointers):
        own = np.zeros(len(back), np.int64)
        for step in range(len(back) - 1, -1, -1):
            own[step] = label
            label = int(back[step, label])
        found.append(own)
    return found[::-1]


def fit(texts: list[str], langs: list[str]) -> LanguageModel | None:
    """Counts of n-grams per language, with add-half smoothing."""
    names = sorted(set(langs))
    if not names:
        return None
    index = {name: k for k, name in enumerate(names)}
    words = [Counter() for _ in names]
    for text, lang in zip(texts, langs):
        words[index[lang]].update(WORD.findall(text.lower()))
    table: dict[str, int] = {}
    counts = [array("d") for _ in names]
    scripts: dict[str, np.ndarray] = {}
    for k, counter in enumerate(words):
        for word, n in counter.items():
            # Whole words seen once in a language say little and would be most of the table.
            for g in grams(word) if n > 1 else grams(word)[:-1]:
                at = table.setdefault(g, len(table))
                if at == len(counts[0]):
                    for column in counts:
                        column.append(0.0)
                counts[k][at] += n
            scripts.setdefault(script(word), np.zeros(len(names)))[k] += n
        counter.clear()
    seen = np.array(counts, float).reshape(len(names), len(table)).T
    seen = np.concatenate([seen, np.zeros((1, len(names)))])
    logs = np.log((seen + 0.5) / (seen.sum(0) + 0.5 * len(seen)))
    per_script = sum(scripts.values(), np.zeros(len(names)))
    allowed = {}
    for name, c in scripts.items():
        fits = c >= SCRIPT_SHARE * np.maximum(per_script, 1)
        allowed[name] = fits if fits.any() else c > 0
    return LanguageModel(names, table, logs, allowed)


def original_positions(text: str, low: str) -> np.ndarray | None:
    """Positions in the text of those in its lower-cased form; null if they are the same."""
    if len(low) == len(text):
        return None
    widths = np.fromiter((len(c.lower()) for c in text), np.int8, len(text))
    return np.append(np.repeat(np.arange(len(text), dtype=np.int32), widths), len(text))


def bounds(low: str) -> list[tuple[int, int]]:
    """Chunks of a text, none of which cuts a word."""
    edges = [0]
    while len(low) - edges[-1] > CHUNK:
        gap = NO_LETTER.search(low, edges[-1] + CHUNK)
        if gap is None:
            break
        edges.append(gap.start())
    return list(zip(edges, [*edges[1:], len(low)]))


def label_long(low: str, model: LanguageModel, penalty: float) -> list[np.ndarray]:
    """Labels of a long text's words, by chunk; scores are held for one chunk at a time."""
    chunks = bounds(low)

    def scores() -> Iterator[np.ndarray]:
        for a, b in chunks:
            words = WORD.findall(low, a, b)
            if words:
                model.prepare(set(words))
                yield model.matrix(words)

    best = int(sum(block.sum(0) for block in scores()).argmax())
    gain = lowest = np.zeros(len(model.names))
    sizes, calm = [], True
    for block in scores():
        steps = np.concatenate([gain[None], gain + np.cumsum(block - block[:, [best]], 0)])
        lows = np.minimum.accumulate(np.concatenate([np.minimum(lowest, gain)[None], steps]), 0)[1:]
        calm = calm and (steps - lows).max() <= penalty / 2
        gain, lowest = steps[-1], lows[-1]
        sizes.append(len(block))
    return [np.full(n, best) for n in sizes] if calm else _walk_one(scores(), penalty)


def edges_of(low: str, labels: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[int]]:
    """Where runs of equal labels start and end in the text, and their labels."""
    every = np.concatenate(labels)
    firsts = np.concatenate([[0], np.flatnonzero(every[1:] != every[:-1]) + 1])
    if len(firsts) == 1:
        stop = len(low)
        while not WORD.match(low, stop - 1):
            stop -= 1
        return [(WORD.search(low).start(), stop)], [int(every[0])]
    starts, stops = array("q"), array("q")
    for a, b in bounds(low):
        for m in WORD.finditer(low, a, b):
            starts.append(m.start())
            stops.append(m.end())
    begin, end = np.array(starts), np.array(stops)
    lasts = np.append(firsts[1:], len(every)) - 1
    return list(zip(begin[firsts].tolist(), end[lasts].tolist())), every[firsts].tolist()


def spans_of(text: str, low: str, labels: list[np.ndarray], names: list[str]) -> tuple[list[tuple[int, int, str]], Counter]:
    edges, kinds = edges_of(low, labels)
    back = original_positions(text, low)
    if back is not None:
        edges = [(int(back[a]), int(back[b - 1]) + 1) for a, b in edges]
    counts = sum(np.bincount(part, minlength=len(names)) for part in labels)
    return [(a, b, names[k]) for (a, b), k in zip(edges, kinds)], Counter({names[k]: int(n) for k, n in enumerate(counts) if n})


def label_texts(texts: list[str], model: LanguageModel, penalty: float = SWITCH) -> list[tuple[list[tuple[int, int, str]], Counter]]:
    """Spans (start, end, language) by code points of each text, and words per language."""
    labels: list[list[np.ndarray] | None] = [None] * len(texts)
    waiting: dict[int, np.ndarray] = {}
    group: dict[int, list[str]] = {}
    held = 0

    def look_up() -> None:
        model.prepare(set().union(*group.values()))
        for i, words in group.items():
            scores = model.matrix(words)
            best = steady(scores, penalty)
            labels[i] = [np.full(len(scores), best or 0)]
            if best is None:
                waiting[i] = scores
        group.clear()

    for i, text in enumerate(texts):
        low = text.lower()
        if len(low) > CHUNK and WORD.search(low):
            labels[i] = label_long(low, model, penalty)
        elif words := WORD.findall(low):
            group[i] = words
            held += len(low)
        if held > CHUNK:
            look_up()
            held = 0
    look_up()
    for i, found in zip(waiting, walk(list(waiting.values()), penalty)):
        labels[i] = [found]
    return [([], Counter()) if own is None else spans_of(text, text.lower(), own, model.names) for text, own in zip(texts, labels)]


def label_spans(text: str, model: LanguageModel, penalty: float = SWITCH) -> tuple[list[tuple[int, int, str]], Counter]:
    """Spans (start, end, language) by code points of the text, and words per language."""
    return label_texts([text], model, penalty)[0]


def main_language(counts: Counter) -> tuple[str, float]:
    """Language with most words, the first of equals by name, and its share of words."""
    if not counts:
        return UNKNOWN, 0.0
    best = min(counts, key=lambda name: (-counts[name], name))
    return best, counts[best] / counts.total()


def predict(text: str, model: LanguageModel, penalty: float = SWITCH) -> tuple[str, float, int]:
    """Language with most words, its share of words, and the number of spans."""
    spans, counts = label_spans(text, model, penalty)
    return *main_language(counts), len(spans)


# --- Spark side --------------------------------------------------------------------------


def train_language(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_chars: int = FIT_CHARS) -> LanguageModel | None:
    """Fit on documents with a language for which ``learn`` holds."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull()).where(learn)
    known = usable.select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), whole_text(text).alias("text"))
    bounded_batches(docs.sparkSession)
    sizes = known.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars")).collect()
    share = {r.lang: min(1.0, fit_chars / len(sizes) / max(r.chars, 1)) for r in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for name, own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body, limit = value.as_py(), share[own] * 2**64
                start = 0
                while start < len(body):
                    gap = NO_LETTER.search(body, start + FIT_CHUNK)
                    stop = gap.start() if gap else len(body)
                    if xxhash.xxh3_64_intdigest(f"{name}:{start}") < limit:
                        langs.append(own)
                        parts.append(body[start:stop])
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.string())], ["lang", "text"])

    sample = known.select("key", "lang", "text").mapInArrow(run, "lang string, text string").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


def identify(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """Per document: key, lang_pred, score (share of words), n_spans, spans.

    Spans are (start, end, lang) in order, by code points of the text, end exclusive: from the
    first to the last of neighbouring words that have the same label.
    """
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = label_texts(texts, model, penalty) if model else [([], Counter())] * len(texts)
            langs, scores = zip(*[main_language(counts) for _, counts in found]) if found else ((),) * 2
            flat = [span for spans, _ in found for span in spans]
            starts, ends, names = zip(*flat) if flat else ((),) * 3
            struct = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(names, pa.string())], ["start", "end", "lang"]
            )
            offsets = np.cumsum([0, *(len(spans) for spans, _ in found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)],
                ["key", "lang_pred", "score", "spans"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    labelled = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
    return labelled.select(F.col("key").alias(key), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), "spans")
