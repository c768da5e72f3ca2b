"""Phrase collocations by counting candidates in double-array tries.

Texts are lower-cased, cut into pieces at punctuation and line breaks, and pieces into words. All
counts are kept by language.

1. Words are counted, the frequent ones numbered, and every text stored once as the numbers of its
   words (0 for a rare word and between pieces, neither of which a frequent phrase can hold).
2. For each length there is one pass over the stored numbers. The candidates of that length are
   compiled into a double-array trie and broadcast. Numpy moves the states of all positions through
   it together, one level a word; the accepting states are counted by ``bincount`` and the
   partitions' counts summed. In the same pass neighbouring positions that both accept, so that the
   first and the last part of the longer phrase are frequent (Apriori), propose it; proposals that
   occur often enough over all partitions are the next pass's candidates. (Enumerating all
   joinable pairs of phrases instead would list every pair that shares a common middle.) Counts
   travel as packed arrays, dealt by a hash of their key into groups of about ``GROUP`` occurrences,
   and each group is summed by itself.
3. Every candidate is scored at its weakest cut, those contained in an equally frequent longer one
   are dropped, and each language's best are ranked.

Numbers and tries are made in parts of at most ``PART`` words or phrases, whose size bounds what is
collected, compiled and broadcast; with more than one part, positions are filled in part by part
(one staged pass each), and results are the same. Long texts are cut in chunks and matched in
slices. Nothing is sampled, and no count is capped.

A null text counts as empty, a null language as ``und``. Repeated rows count each time. Tables
without a frequent phrase give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.llm.common import Workspace, bounded_batches, text_bytes
from attestor.operators.ledger import assign_ids

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
PART = 400_000
CHUNK = 1 << 20
SLICE = 1 << 18
BLOCK = 1 << 18
COUNTED_WORDS = 100_000
PROPOSED_TOGETHER = 1 << 19
GROUP = 1 << 19
# Bytes handed to or taken from a Python task at once: both sides hold them in buffers that stay allocated.
HANDED = 2 << 20
DENSE = 1 << 22

_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
# No UTF-8 text holds this byte.
BREAK = b"\xff"


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The text's words in lists of bounded length, with ``BREAK`` between pieces."""
    plain = data.lower().translate(_PLAIN)
    start = 0
    while start < len(plain):
        stop = -1
        if start + CHUNK < len(plain):
            ends = [e for e in (plain.find(b" ", start + CHUNK), plain.find(b"\n", start + CHUNK)) if e >= 0]
            stop = min(ends, default=-1)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].replace(b"\n", b" " + BREAK + b" ").split()
        start = stop


# --- the trie ------------------------------------------------------------------------------


class DoubleArray:
    """Phrases of one length over word numbers: ``check[base[s] + label] == s`` leads from a state s.

    ``value`` holds the phrase's number at accepting states. Labels are 1 for the first of the words
    that occur in it, and so on; the root's transitions take the first cells, all other states
    follow behind them.
    """

    def __init__(self, phrases: np.ndarray, numbers: np.ndarray) -> None:
        self.depth = phrases.shape[1]
        self.letters = np.unique(phrases)
        self.dense = None
        order = np.lexsort(phrases.T[::-1])
        rows = np.searchsorted(self.letters, phrases[order]) + 1
        width = len(self.letters) + 1
        used = np.zeros(width + 1, bool)
        used[:width] = True
        base, check, value = {}, {}, {}
        # Slots of the states reached so far, one per distinct beginning of the rows.
        state_of = np.zeros(len(rows), np.int64)
        for level in range(self.depth):
            begins = np.ones(len(rows), bool)
            begins[1:] = (rows[1:, : level + 1] != rows[:-1, : level + 1]).any(1)
            firsts = np.flatnonzero(begins)
            parents, labels = state_of[firsts], rows[firsts, level]
            if level == 0:
                slots, bases = labels, np.zeros(1, np.int64)
                owners = np.zeros(1, np.int64)
            else:
                slots, owners, bases, used = self._place(parents, labels, used, width)
            base.update(zip(owners.tolist(), bases.tolist()))
            check.update(zip(slots.tolist(), parents.tolist()))
            state_of = slots[np.cumsum(begins) - 1]
        value.update(zip(state_of.tolist(), np.asarray(numbers)[order].tolist()))
        size = max([*base.values(), *check], default=0) + width + 1
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for array, cells in ((self.base, base), (self.check, check), (self.value, value)):
            if cells:
                array[np.fromiter(cells, np.int64, len(cells))] = np.fromiter(cells.values(), np.int64, len(cells))

    @staticmethod
    def _place(parents: np.ndarray, labels: np.ndarray, used: np.ndarray, width: int) -> tuple:
        """Cells for the children of each parent: large families first, single children last."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(parents)])
        slots, bases = np.zeros(len(parents), np.int64), np.zeros(len(starts), np.int64)
        at = width
        for f in np.argsort(-sizes, kind="stable"):
            if sizes[f] == 1:
                break
            own = labels[starts[f] : starts[f] + sizes[f]]
            while True:
                need = at + 512 + width + 1
                if need > len(used):
                    used = np.concatenate([used, np.zeros(max(need, len(used)), bool)])
                tries = at + np.arange(512) - own[0]
                fits = ~used[tries[:, None] + own].any(1)
                if fits.any():
                    break
                at += 512
            bases[f] = tries[fits.argmax()]
            slots[starts[f] : starts[f] + sizes[f]] = bases[f] + own
            used[bases[f] + own] = True
            at = max(at, int(bases[f]))
        single = np.flatnonzero(sizes == 1)
        if len(single):
            used = np.concatenate([used, np.zeros(len(single), bool)])
            free = np.flatnonzero(~used[width:])[: len(single)] + width
            slots[starts[single]], bases[single] = free, free - labels[starts[single]]
            used[free] = True
        return slots, parents[starts], bases, used

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """Labels of word numbers, 0 where no phrase holds the word."""
        if not len(self.letters):
            return np.zeros(len(ids), np.int32)
        if self.letters[-1] >= DENSE:
            at = np.minimum(np.searchsorted(self.letters, ids), len(self.letters) - 1)
            return np.where(self.letters[at] == ids, at + 1, 0)
        if self.dense is None:
            self.dense = np.zeros(int(self.letters[-1]) + 2, np.int32)
            self.dense[self.letters] = np.arange(1, len(self.letters) + 1)
        return self.dense[np.minimum(ids, len(self.dense) - 1)]

    def match(self, ids: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions below ``upto`` where a phrase starts, and their accepting states."""
        labels = np.concatenate([self.labels(ids), np.zeros(self.depth, np.int32)])
        live = np.flatnonzero(labels[:upto])
        state = np.zeros(len(live), np.int32)
        for level in range(self.depth):
            label = labels[live + level]
            to = self.base[state] + label
            on = (label > 0) & (self.check[to] == state)
            live, state = live[on], to[on]
        return live, state


# --- passes over the texts -----------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """How often each word occurs: lang, word, n. ``texts`` has lang and text (UTF-8 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, c in counts.items() for _ in range(len(c))]
            words = pa.array([w for c in counts.values() for w in c], pa.binary()).cast(pa.string())
            numbers = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), words, numbers], ["lang", "word", "n"])

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words in word_chunks(value.as_py()):
                    counts[lang].update(words)
                    del counts[lang][BREAK]
                    if sum(map(len, counts.values())) > COUNTED_WORDS:
                        yield flush()
        yield flush()

    # Each task has added up its words; a second map of them in the JVM would only take memory.
    counted = texts.mapInArrow(run, "lang string, word string, n bigint").repartition("lang", "word")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def parts_of(numbered: DataFrame, part: int) -> Iterator[DataFrame]:
    """The rows of a table with dense ids from 1, by ranges of at most ``part`` ids."""
    last = numbered.agg(F.max("id")).first()[0] or 0
    for start in range(0, max(last, 1), part):
        yield numbered.where(F.col("id").between(start + 1, start + part))


def encode_words(texts: DataFrame, words: DataFrame, space: Workspace, part: int) -> DataFrame:
    """Texts as blocks of word numbers: ids (little-endian 32-bit integers, 0 at both ends)."""
    spark = texts.sparkSession
    rows = texts.select("lang", "text", F.lit(None).cast("binary").alias("ids"))
    every = list(parts_of(words, part))

    def fill(known, final: bool):
        def of(lang: str, data: bytes, before: bytes | None) -> np.ndarray:
            get = known.value.get(lang, {}).get
            found = [np.fromiter(map(get, chunk, repeat(0)), np.int32, len(chunk)) for chunk in word_chunks(data)]
            ids = np.concatenate([np.zeros(0, np.int32), *found])
            return ids if before is None else np.maximum(ids, np.frombuffer(before, "<i4"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [np.zeros(1, np.int32)], 0

            def block() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<i4").tobytes()], pa.binary())], ["ids"])

            for batch in batches:
                out = []
                for lang, value, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    ids = of(lang, value.as_py(), before.as_py())
                    if not final:
                        out.append(ids.astype("<i4").tobytes())
                        continue
                    held += [ids, np.zeros(1, np.int32)]
                    size += len(ids)
                    if size > BLOCK:
                        yield block()
                        held, size = [np.zeros(1, np.int32)], 0
                if not final:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "text", "ids"])
            if final and size:
                yield block()

        return run

    for i, some in enumerate(every):
        by_lang: dict[str, dict[bytes, int]] = defaultdict(dict)
        for row in some.select("lang", "word", "id").collect():
            by_lang[row.lang][row.word.encode()] = row.id
        final = i == len(every) - 1
        known = spark.sparkContext.broadcast(dict(by_lang))
        found = rows.mapInArrow(fill(known, final), "ids binary" if final else rows.schema)
        rows = space.put(f"encoded{i}", found)
        known.unpersist()
    return rows


def slices(ids: np.ndarray, ahead: int) -> Iterator[tuple[np.ndarray, int]]:
    """Windows of positions: their numbers with ``ahead`` more, and how many are their own."""
    for start in range(0, len(ids), SLICE):
        own = min(SLICE, len(ids) - start)
        yield ids[start : start + own + ahead], own


PACKED = "g int, keys binary, counts binary, ids binary, at binary"


def packed(keys: np.ndarray, counts: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Counted keys as one row for each group that has some, in batches of about ``HANDED`` bytes."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    of = (mixed % np.uint64(groups)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0]) if len(of) else np.zeros(0, int)
    found, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        none = pa.nulls(len(found), pa.binary())
        found.clear()
        return pa.RecordBatch.from_arrays([*columns, none, none], ["g", "keys", "counts", "ids", "at"])

    for part in np.split(order, firsts[1:]):
        for i in range(0, len(part), HANDED // 16):
            some = part[i : i + HANDED // 16]
            if size and size + 16 * len(some) > HANDED:
                yield batch()
                size = 0
            found.append((of[some[0]], keys[some].tobytes(), counts[some].tobytes()))
            size += 16 * len(some)
    if found:
        yield batch()


def summed(rows: DataFrame, least: int) -> DataFrame:
    """Sums of packed counts, those of at least ``least``: (a, b, n), both halves of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        group = None

        def total() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(k for k, _ in held), np.int64)
            counts = np.frombuffer(b"".join(c for _, c in held), np.int64)
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            sums = np.add.reduceat(counts, firsts) if len(firsts) else counts
            often = sums >= least
            keys = keys[firsts][often]
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(sums[often])], ["a", "b", "n"])

        for batch in batches:
            for g, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if held and g != group:
                    yield total()
                group = g
                held.append((keys.as_py(), counts.as_py()))
        if held:
            yield total()

    dealt = rows.where("g is not null").select("g", "keys", "counts").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def phrase_pass(blocks: DataFrame, phrases: DataFrame | None, depth: int, propose: bool, space: Workspace, part: int, groups: int, least: int) -> DataFrame:
    """One pass over the blocks: (a, b, n), counts of phrase a where b is 0, else of proposals a b.

    Without ``phrases`` the words themselves are the phrases, and only proposals are counted.
    """
    context = blocks.sparkSession.sparkContext
    tries = [None]
    if phrases is not None:
        tries = list(parts_of(phrases, part))
        blocks = blocks.withColumn("at", F.lit(None).cast("binary"))

    def numbers(trie: DoubleArray, ids: np.ndarray, before: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The phrase that starts at each position (0: none), and how often each state accepts."""
        out = np.zeros(len(ids), np.int32) if before is None else np.frombuffer(before, "<i4").copy()
        counts = np.zeros(len(trie.value), np.int64)
        for i, (window, own) in enumerate(slices(ids, depth)):
            live, state = trie.match(window, own)
            counts += np.bincount(state, minlength=len(counts))
            out[live + i * SLICE] = trie.value[state]
        return out, counts

    def counting(shared, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = shared.value if shared else None
            counts = np.zeros(len(trie.value) if trie else 0, np.int64)
            held: list[np.ndarray] = []

            def proposals() -> Iterator[pa.RecordBatch]:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                return packed(keys, n, groups)

            for batch in batches:
                for i, value in enumerate(batch.column(0)):
                    ids = np.frombuffer(value.as_buffer(), "<i4")
                    if trie is None:
                        at = ids
                    else:
                        at, more = numbers(trie, ids, batch.column(1)[i].as_py())
                        counts += more
                    if not final:
                        none = pa.nulls(1, pa.binary())
                        row = [pa.nulls(1, pa.int32()), none, none, pa.array([value.as_py()], pa.binary()), pa.array([at.tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(row, ["g", "keys", "counts", "ids", "at"])
                    elif propose:
                        both = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
                        held.append(at[both].astype(np.int64) << 32 | at[both + 1])
                        if sum(map(len, held)) > PROPOSED_TOGETHER:
                            yield from proposals()
            if held:
                yield from proposals()
            states = np.flatnonzero(counts)
            if len(states):
                yield from packed(trie.value[states].astype(np.int64) << 32, counts[states], groups)

        return run

    found = []
    for i, some in enumerate(tries):
        shared, final = None, i == len(tries) - 1
        if some is not None:
            rows = some.select("id", "ids").toArrow()
            words = np.array(rows.column("ids").to_pylist(), np.int64).reshape(rows.num_rows, depth)
            shared = context.broadcast(DoubleArray(words, np.array(rows.column("id").to_pylist(), np.int64)))
        out = blocks.mapInArrow(counting(shared, final), PACKED)
        if not final:
            out = space.put(f"pass{depth}_{i}", out)
            blocks = out.where("ids is not null").select("ids", "at")
        found.append(out)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return summed(every, least)


def frequent_phrases(docs: DataFrame, space: Workspace, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), and words and longer phrases that are frequent (lang, words, n)."""
    bounded_batches(docs.sparkSession, HANDED)
    language = F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))
    texts = docs.select(language.alias("lang"), text_bytes(text).alias("text"))
    counted = space.put("counted", word_counts(texts))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    groups = ((totals.agg(F.sum("n")).first()[0] or 0) // GROUP) + 1
    words = space.put("words", assign_ids(counted.where(F.col("n") >= least), ["lang", "word"]))
    blocks = encode_words(texts, words, space, part)
    known = words.select("id", "lang", F.array("word").alias("words"), F.array(F.col("id").cast("int")).alias("ids"))
    rows = space.put("pairs", phrase_pass(blocks, None, 1, longest > 1, space, part, groups, least))
    phrases = None
    for depth in range(2, longest + 1):
        proposed = rows.where("b > 0")
        front = known.select(F.col("id").alias("a"), "lang", "words", "ids")
        back = known.select(F.col("id").alias("b"), F.element_at("words", -1).alias("word"), F.element_at("ids", -1).alias("last"))
        joined = proposed.join(front, "a").join(back, "b").select(
            "a", "b", "lang", F.concat("words", F.array("word")).alias("words"), F.concat("ids", F.array("last")).alias("ids")
        )
        known = space.put(f"known{depth}", assign_ids(joined, ["a", "b"]).select("id", "lang", "words", "ids"))
        if known.isEmpty():
            break
        rows = space.put(f"rows{depth}", phrase_pass(blocks, known, depth, depth < longest, space, part, groups, least))
        sums = rows.where("b = 0").select(F.col("a").alias("id"), "n")
        more = known.join(sums, "id").select("lang", "words", "n")
        phrases = more if phrases is None else phrases.unionByName(more)
    if phrases is None:
        phrases = known.select("lang", "words", F.lit(0).cast("long").alias("n")).where(F.lit(False))
    return totals, words.select("lang", F.array("word").alias("words"), "n"), phrases


# --- scores ----------------------------------------------------------------------------------


def text_of(words: Column | str) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, part: int = PART) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of
    the language; the score is ``1000 * a * n / (l * r)``, rounded down.
    """
    space = Workspace(docs.sparkSession, "collocations")
    totals, words, phrases = frequent_phrases(docs, space, text, lang, least, longest, part)
    phrases = space.put("phrases", phrases.withColumn("phrase", text_of("words")))
    parts = phrases.select("lang", "phrase", "n").unionByName(words.select("lang", text_of("words").alias("phrase"), "n"))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "words", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", text_of(F.slice("words", F.lit(1), F.col("cut"))).alias("first"), text_of(F.expr("slice(words, cut + 1, size(words))")).alias("rest"))
    first = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
    # Whole numbers of 38 digits: products of three counts pass 64 bits, and nothing is rounded twice.
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    weakest = scored.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("weakest")
    )
    # Every phrase inside a longer one, with the count of the longer one.
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: text_of(F.slice("words", i, k))),
    ))
    inside = phrases.where(F.size("words") > 2).select("lang", "n", F.explode(F.array_distinct(inner)).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = weakest.join(covered, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("weakest.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "weakest.l", "weakest.r", "n", F.col("weakest.score").cast("long").alias("score"))


COLLOCATIONS_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '{UNKNOWN}') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, range(1, {LONGEST + 1}) AS sizes(k)),
f AS (SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS n FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
candidates AS (SELECT lang, k, words, n AS a FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scores AS (
  SELECT cuts.lang, cuts.k, cuts.words, a, c, x.n AS l, y.n AS r, totals.n,
         (CAST(1000 AS HUGEINT) * a * totals.n) // (CAST(x.n AS HUGEINT) * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.words = cuts.words[1:c]
       JOIN f y ON y.lang = cuts.lang AND y.words = cuts.words[c + 1:]
       JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, c) = 1),
inside AS (
  SELECT lang, words[i:i + s - 1] AS words, max(a) AS longer
  FROM (SELECT lang, words, a, s, unnest(range(1, k - s + 2)) AS i FROM candidates, range(2, {LONGEST}) AS sizes(s) WHERE s < k)
  GROUP BY ALL),
kept AS (
  SELECT weakest.*, array_to_string(weakest.words, ' ') AS phrase
  FROM weakest LEFT JOIN inside ON inside.lang = weakest.lang AND inside.words = weakest.words
  WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}
"""
