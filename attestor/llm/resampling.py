"""Importance resampling of documents towards a target distribution.

A text's features are its runs of one to three words, hashed into ``BUCKETS`` buckets. Counts over
all documents and over the whole target give every bucket a gain; a document's weight is the sum
of its features' gains, looked up in one array. With Gumbel noise drawn from the document's key, the
highest scores are a sample without replacement, in proportion to the weights' exponentials.

The draw never sorts the documents. Scores are stored once; the cut-off is found by bisection, each
step a job that counts exactly how many rows lie above some thresholds. Ties at the cut-off are
cut by the key in the same way. Only the drawn rows are range-partitioned for their ranks.

A null text has no words and weight 0. A null key is hashed as the empty text and comes last among
ties. Rows that agree in score and key have equal claims: if only some of them fit, those with fewer
features come first, and rows that agree in that too are alike. Repeated rows are rows of their
own. Fewer than ``LEAST_WORDS`` words: never drawn. Empty tables draw nothing. Keys are whole
numbers; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import Workspace, bounded_batches, text_bytes
from attestor.operators.ledger import assign_ids

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
# Thresholds that one counting job tests; the interval shrinks by as much each time.
WAYS = 32
CHUNK = 1 << 20
LAST = (1 << 63) - 1

# Bytes that belong to words once A-Z are lower-cased; all others part them.
_WORD_BYTES = frozenset(chain(b"0123456789abcdefghijklmnopqrstuvwxyz", range(0x80, 0x100)))
_PARTED = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256))


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The text's words in lists of bounded length, so that a long text is never one list."""
    plain = data.lower().translate(_PARTED)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + CHUNK) if start + CHUNK < len(plain) else -1
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def hashed_features(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Per chunk of the text: its number of words, and the buckets of the runs that end in it."""
    tail: list[bytes] = []
    for words in word_chunks(data):
        run = tail + words
        spaced = [b" " + w for w in run]
        codes, parts = list(map(crc32, run)), []
        for n in range(LONGEST):
            # The CRC of a run goes on from the CRC of the run without its last word.
            codes = list(map(crc32, spaced[n:], codes)) if n else codes
            parts.append(codes[max(len(tail) - n, 0) :])
        found = np.fromiter(chain.from_iterable(parts), np.uint32, sum(map(len, parts)))
        yield len(words), found % BUCKETS
        tail = run[-(LONGEST - 1) :]


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features all texts have in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, buckets in hashed_features(value.as_py()):
                    np.add.at(counts, buckets, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    rows = texts.select(text_bytes(text)).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: 1000 times the log ratio of its smoothed shares, rounded down."""
    s_all, t_all = int(raw.sum()), int(target.sum())
    pairs = zip(raw.tolist(), target.tolist())
    ratios = (float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS)) for s, t in pairs)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_features, weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sums = np.zeros((len(batch), 3), np.int64)
            for i, value in enumerate(batch.column(1)):
                for n_words, buckets in hashed_features(value.as_py()):
                    sums[i] += n_words, len(buckets), table[buckets].sum()
            columns = [batch.column(0), *(pa.array(c) for c in sums.T)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_features", "weight"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def least_reaching(rows: DataFrame, column: str, wanted: int) -> int:
    """The smallest whole number that at least ``wanted`` rows do not exceed in ``column``.

    Each job counts the rows below evenly spaced thresholds and keeps the one interval that the
    answer lies in. There must be that many rows.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        cuts = sorted({low + (high - low) * i // WAYS for i in range(WAYS)})
        below = [F.count(F.when(F.col(column) <= F.lit(c).cast("long"), 1)) for c in cuts]
        reached = [n >= wanted for n in rows.agg(*below).first()]
        at = reached.index(True) if any(reached) else len(cuts)
        low = cuts[at - 1] + 1 if at else low
        high = cuts[at] if at < len(cuts) else high
    return low


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Per document: key, n_words, n_features, weight, score, rank (null where not drawn)."""
    bounded_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    space = Workspace(docs.sparkSession, "resample")
    scored = weigh(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    turn = F.coalesce(F.col("key").cast("long"), F.lit(LAST))
    scored = space.put("scored", scored.withColumn("turn", turn).withColumn("depth", -F.col("score")))
    able = scored.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    if not wanted:
        return scored.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    depth = least_reaching(able, "depth", wanted)
    ties = able.where(F.col("depth") == depth)
    last = least_reaching(ties, "turn", wanted - able.where(F.col("depth") < depth).count())
    drawn = (F.col("n_words") >= least_words) & ((F.col("depth") < depth) | ((F.col("depth") == depth) & (F.col("turn") <= last)))
    # Rows beyond the wanted number can only be repeats of the last key with its score.
    ranked = assign_ids(scored.where(drawn), ["depth", "turn", "n_features"])
    ranked = ranked.withColumn("rank", F.when(F.col("id") <= wanted, F.col("id")))
    out = ranked.drop("id").unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


# The CRC is taken bit by bit: every byte is followed by eight shifts, marked -1.
RESAMPLE_SQL = f"""
WITH every AS (
  SELECT 0 AS kind, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
cut AS (
  SELECT row_number() OVER () AS id, kind, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM every),
found AS (
  SELECT id, kind, array_to_string(w[i:i + k], ' ') AS f
  FROM (SELECT id, kind, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM cut, range({LONGEST}) AS sizes(k))),
bits AS (
  SELECT f, flatten(list_transform(range(1, length(hex(f)), 2), lambda i:
           [(strpos('0123456789ABCDEF', hex(f)[i]) - 1) * 16 + strpos('0123456789ABCDEF', hex(f)[i + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1])) AS b
  FROM (SELECT DISTINCT f FROM found)),
crcs AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x:
           CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % {BUCKETS} AS bucket
  FROM bits),
placed AS (SELECT id, kind, bucket FROM found JOIN crcs USING (f)),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM placed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (t_all + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM counts, sums),
weights AS (SELECT id, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT id, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM cut LEFT JOIN weights USING (id) WHERE kind = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r,
         {PERCENT} * count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () // 100 AS wanted
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= wanted THEN r END AS rank FROM ranked
"""
