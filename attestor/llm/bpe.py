"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

Texts are cut into pieces as byte-level tokenizers do. Frequent pieces (counted by Spark over
all documents) are compiled into a minimal acyclic automaton with shared prefixes and suffixes,
whose arc outputs add up to a piece's number and so to its ids. The file is written to the shared
scratch folder, shipped to every executor with ``addFile`` and memory-mapped there. Pieces it does not
know are merged exactly, by lowest merge rank. The lexicon only saves work: results do not depend on
it, nor on its size.

Encoding, decoding and digests of a text are one pass in one task. Long texts are encoded in chunks,
cut where no later text can move a border between pieces, and decoded in chunks of ids.

A null text counts as empty and has no ids. Strings of added tokens inside a text become their id.
Very long pieces are merged with a heap in n log n steps. Repeated rows are encoded one by one;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import Workspace, bounded_batches, text_bytes, whole_text
from attestor.session import scratch_path

LEXICON_WORDS = 32_768
CACHED_PIECES = 250_000
COUNTED_PIECES = 200_000
ENCODED_TOGETHER = 100_000
CHUNK = 1 << 18
MERGED_TOGETHER = 8192
SHORT_PIECE = 48

# The published byte-level split, with white space written out (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
# The same for texts of ASCII characters only.
ASCII_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


# A blank between two other characters always begins a piece and ends one, whatever follows.
BORDER = regex.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def pieces(text: str) -> list[str]:
    return (ASCII_SPLIT if text.isascii() else SPLIT).findall(text)


def text_chunks(text: str) -> Iterator[str]:
    """The text in chunks whose pieces are together those of the whole text."""
    start = 0
    while len(text) - start > CHUNK:
        border = BORDER.search(text, start + CHUNK)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:] if start else text


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# --- the lexicon -------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton's file: numbers of states, arcs and ids, then the arrays.

    Words are added in order; once a branch is finished, each of its states is replaced by an
    equal one seen before (same finality, arcs and targets), which makes the automaton minimal.
    """
    # A state under construction: [final, {byte: state}]; a finished one is its number.
    known: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[list[tuple[int, int]]] = []

    def finish(state: list) -> int:
        out = tuple(state[1].items())
        mark = (state[0], out)
        if mark not in known:
            known[mark] = len(finals)
            finals.append(state[0])
            arcs.append(list(out))
        return known[mark]

    path: list[list] = [[False, {}]]
    last = b""
    ordered = sorted(words)
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            done = path.pop()
            path[-1][1][last[len(path) - 1]] = finish(done)
        for byte in word[same:]:
            path[-1][1][byte] = None
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1][last[len(path) - 1]] = finish(done)
    root = finish(path[0])
    # Words reachable from each state; targets always have smaller numbers than their sources.
    below = [0] * len(finals)
    for s in range(len(finals)):
        below[s] = finals[s] + sum(below[t] for _, t in arcs[s])
    labels, targets, outputs = [], [], []
    for s in range(len(finals)):
        before = int(finals[s])
        for byte, t in arcs[s]:
            labels.append(s << 8 | byte)
            targets.append(t)
            outputs.append(before)
            before += below[t]
    starts = np.cumsum([0] + [len(words[w]) for w in ordered])
    ids = [i for w in ordered for i in words[w]]
    head = struct.pack("<5I", root, len(finals), len(labels), len(ordered), len(ids))
    return head + b"".join(np.asarray(part, "<u4").tobytes() for part in (labels, targets, outputs, finals, starts, ids))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=1))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lengths


class Lexicon:
    """A compiled lexicon in any buffer, usually a memory-mapped file. Arcs are sorted by
    (state, byte); many words walk the automaton together, one byte a step."""

    def __init__(self, buffer) -> None:
        self.root, states, arcs, words, ids = struct.unpack_from("<5I", buffer)
        at, parts = 20, []
        for n in (arcs, arcs, arcs, states, words + 1, ids):
            parts.append(np.frombuffer(buffer, "<u4", n, at))
            at += 4 * n
        self.labels, self.targets, self.outputs, self.finals, self.starts, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, the sums of their arcs' outputs; -1 where not accepted."""
        table, lengths = padded(words)
        state = np.full(len(words), self.root, np.int64)
        number = np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.labels) else np.zeros(0, np.int64)
        alive = np.zeros(len(words), bool)
        for k in range(table.shape[1] + 1):
            ended = lengths[live] == k
            alive[live[ended]] = self.finals[state[live[ended]]] == 1
            live = live[~ended]
            if not len(live):
                break
            label = state[live] << 8 | table[live, k]
            arc = np.minimum(np.searchsorted(self.labels, label), len(self.labels) - 1)
            found = self.labels[arc] == label
            live, arc = live[found], arc[found]
            number[live] += self.outputs[arc]
            state[live] = self.targets[arc]
        return np.where(alive, number, -1)

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each word, None where the automaton does not accept it."""
        return [None if n < 0 else self.ids[self.starts[n] : self.starts[n + 1]] for n in self.numbers(words)]


# --- the codec ---------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Tables of a tokenizer file; their size is fixed by the file, not by the data."""

    byte_ids: np.ndarray
    pairs: np.ndarray  # sorted (left id << 32 | right id) of all merges
    ranks: np.ndarray  # their ranks
    merged: np.ndarray  # ids of the merged tokens, by rank
    tokens: list[bytes]
    byte_ranks: np.ndarray  # ranks of all pairs of single bytes
    added: dict[str, int] = field(default_factory=dict)


def load_vocabulary(path: str | None = None) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, ids = byte_letters(), spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    for token, i in added.items():
        tokens[i] = token.encode()
    pairs, merged = [], []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append(ids[a] << 32 | ids[b])
        merged.append(ids[a + b])
    order = np.argsort(pairs)
    by_byte = {b: ids[c] for c, b in letters.items()}
    byte_ids = np.array([by_byte[b] for b in range(256)])
    v = Vocabulary(byte_ids, np.array(pairs)[order], order, np.array(merged), tokens, np.zeros((256, 256), np.int64), added)
    v.byte_ranks = pair_ranks(np.repeat(byte_ids, 256), np.tile(byte_ids, 256), v).reshape(256, 256)
    return v


NO_MERGE = 1 << 40


def pair_ranks(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Merge ranks of neighbouring ids, NO_MERGE where there is none; id -1 is no token."""
    wanted = left << 32 | right
    at = np.minimum(np.searchsorted(v.pairs, wanted), len(v.pairs) - 1)
    return np.where((v.pairs[at] == wanted) & (left >= 0) & (right >= 0), v.ranks[at], NO_MERGE)


def merge_many(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each piece: always the merge of lowest rank, the leftmost of equal ones."""
    return [np.frombuffer(ids, "<u4").astype(np.int64) for ids in merged_bytes(words, v)]


def merged_bytes(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """The same, ids as little-endian unsigned 32-bit integers.

    All words take their next merge together; short and long ones apart, to keep rows even.
    """
    out: list[bytes] = [b""] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = [i for i in order if 0 < len(words[i]) <= SHORT_PIECE]
    for i in order[len(order) - sum(len(w) > SHORT_PIECE for w in words) :]:
        out[i] = np.array(merge_long(words[i], v), "<u4").tobytes()
    for start in range(0, len(short), MERGED_TOGETHER):
        chunk = short[start : start + MERGED_TOGETHER]
        ids = merge_rows(*padded([words[i] for i in chunk]), v)
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        for i, a, b in zip(chunk, [0, *ends], ends):
            out[i] = flat[a:b]
    return out


def merge_rows(table: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids of one word a row, -1 where none is left.

    A row is a linked list: the last cell stands behind every end and before every start, has no
    id and no rank, so that no step needs to look for borders.
    """
    n, width = table.shape
    row = width + 1
    columns = np.arange(row, dtype=np.int32)
    ids = np.full((n, row), -1, np.int64)
    ids[:, :width] = np.where(columns[:width] < lengths[:, None], v.byte_ids[table], -1)
    after = np.tile(np.minimum(columns + 1, width), (n, 1))
    after[columns[None, :] + 1 >= lengths[:, None]] = width
    before = np.tile(np.where(columns > 0, columns - 1, width).astype(np.int32), (n, 1))
    ranks = np.full((n, row), NO_MERGE)
    ranks[:, : width - 1] = v.byte_ranks[table[:, :-1], table[:, 1:]]
    ranks[:, :width][columns[None, :width] + 1 >= lengths[:, None]] = NO_MERGE
    flat_ids, flat_after, flat_before, flat_ranks = ids.ravel(), after.ravel(), before.ravel(), ranks.ravel()
    live = np.arange(n)
    while True:
        at = ranks[live].argmin(1)
        best = ranks[live, at]
        going = best < NO_MERGE
        live, at, best = live[going], at[going], best[going]
        if not len(live):
            return ids[:, :width]
        base = live * row
        here, gone = base + at, base + flat_after[base + at]
        behind = flat_after[gone]
        flat_ids[here], flat_ids[gone], flat_ranks[gone] = v.merged[best], -1, NO_MERGE
        flat_after[here], flat_before[base + behind] = behind, at
        flat_ranks[here] = pair_ranks(flat_ids[here], flat_ids[base + behind], v)
        ahead = base + flat_before[here]
        flat_ranks[ahead] = pair_ranks(flat_ids[ahead], flat_ids[here], v)


def merge_long(word: bytes, v: Vocabulary) -> list[int]:
    """The same for one long piece, with a heap: n log n steps."""
    parts = v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    end = len(parts)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(pair_ranks(np.array([a]), np.array([b]), v)[0])
        return known[a, b]

    first = pair_ranks(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64), v).tolist()
    heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r < NO_MERGE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= end or parts[j] != b:
            continue
        parts[i], parts[j] = int(v.merged[r]), -1
        after[i] = after[j]
        if after[j] < end:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < end and (r := rank(parts[k], parts[after[k]])) < NO_MERGE:
                heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
    return [p for p in parts if p >= 0]


class Encoder(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers, kept while they fit."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None

    def learn(self, unseen: list[str]) -> None:
        words = [p.encode() for p in unseen]
        ids = self.lexicon.find(words) if self.lexicon and words else [None] * len(words)
        rest = [i for i, known in enumerate(ids) if known is None]
        self.update((p, i.astype("<u4").tobytes()) for p, i in zip(unseen, ids) if i is not None)
        self.update(zip([unseen[i] for i in rest], merged_bytes([words[i] for i in rest], self.vocabulary)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; pieces are looked up in groups that fit in memory."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str] | bytes]] = []
        held = 0
        for n, text in enumerate(texts):
            for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    group.append((n, struct.pack("<I", self.vocabulary.added[part])))
                    continue
                for chunk in text_chunks(part):
                    group.append((n, pieces(chunk)))
                    held += len(group[-1][1])
                    if held > ENCODED_TOGETHER:
                        self.flush(group, out)
                        held = 0
        self.flush(group, out)
        return [b"".join(own) for own in out]

    def flush(self, group: list[tuple[int, list[str] | bytes]], out: list[list[bytes]]) -> None:
        """Add the ids of a group of chunks to those of their texts."""
        if len(self) > CACHED_PIECES:
            self.clear()
        own: set[str] = set()
        for _, part in group:
            if isinstance(part, list):
                own.update(part)
        self.learn(list(own.difference(self)))
        for n, part in group:
            out[n].append(part if isinstance(part, bytes) else b"".join(map(self.__getitem__, part)))
        group.clear()


def decode(ids: bytes, vocabulary: Vocabulary) -> bytes:
    """UTF-8 of the decoded text; bytes that are no valid UTF-8 become replacement characters."""
    token = vocabulary.tokens.__getitem__
    numbers = np.frombuffer(ids, "<u4")
    if len(numbers) <= CHUNK:
        raw = b"".join(map(token, numbers.tolist()))
    else:
        raw = b"".join(b"".join(map(token, numbers[i : i + CHUNK].tolist())) for i in range(0, len(numbers), CHUNK))
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


# --- Spark side --------------------------------------------------------------------------


def count_pieces(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each piece occurs in all the texts: piece, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["piece", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                for chunk in text_chunks(value.as_py()):
                    counts.update(pieces(chunk))
                    if len(counts) > COUNTED_PIECES:
                        yield flush()
        yield flush()

    counted = docs.select(whole_text(text).alias("text")).mapInArrow(run, "piece string, n bigint")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces, ``words`` at most, that are worth a place in the lexicon.

    A small histogram of frequencies gives the least one; all pieces above it are taken. A sort
    with a limit would send that many pieces from every partition to the driver.
    """
    space = Workspace(docs.sparkSession, "pieces")
    counted = count_pieces(docs, text).where((F.col("n") > 1) & F.octet_length("piece").between(2, SHORT_PIECE))
    # Eight classes an octave: a few hundred rows for any corpus.
    counted = space.put("counted", counted.withColumn("class", F.floor(8 * F.log2("n")).cast("int")))
    least, taken = None, 0
    for row in counted.groupBy("class").agg(F.count("*").alias("pieces")).orderBy(F.desc("class")).collect():
        taken += row.pieces
        if taken > words:
            break
        least = row["class"]
    chosen = [] if least is None else [r.piece for r in counted.where(F.col("class") >= least).select("piece").collect()]
    space.close()
    return sorted(chosen)


def ship_lexicon(spark: SparkSession, lexicon: bytes) -> str:
    """Write the file once to the shared folder and send it to all executors; its file name, which
    no other run has."""
    folder = scratch_path(spark, "lexicon")
    target = f"{folder}/{folder.rsplit('/', 1)[1]}.bin"
    system, path = pyarrow.fs.FileSystem.from_uri(target if "://" in target or target.startswith("file:") else f"file://{target}")
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(lexicon)
    spark.sparkContext.addFile(target)
    return target.rsplit("/", 1)[1]


def open_lexicon(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as file:
        return Lexicon(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


def prepare(docs: DataFrame, text: str, tokenizer: str | None, words: int):
    """What tasks need: a function that gives an encoder, and the broadcast vocabulary."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = load_vocabulary(tokenizer)
    plain = Encoder(vocabulary)
    plain.learn(frequent(docs, text, words))
    lexicon = {p.encode(): np.frombuffer(ids, "<u4").tolist() for p, ids in plain.items()}
    name = ship_lexicon(spark, compile_lexicon(lexicon))
    tables = spark.sparkContext.broadcast(vocabulary)
    return (lambda: Encoder(tables.value, open_lexicon(name))), tables


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """Per document: key, ids (little-endian unsigned 32-bit integers)."""
    encoder_of, _ = prepare(docs, text, tokenizer, words)
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """The rows of ``encoded`` with the decoded text (UTF-8 bytes) as another column."""
    tables = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))
    at = encoded.columns.index(ids)
    names = [*encoded.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(i.as_py(), tables.value) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names)

    return encoded.mapInArrow(run, encoded.withColumn(out, text_bytes(F.lit(""))).schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """Per document: key, n_tokens, ids_sha256, decoded_sha256.

    Ids and decoded texts are hashed where they are made and never leave their task.
    """
    encoder_of, tables = prepare(docs, text, tokenizer, words)
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = encoder_of(), tables.value
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            columns = [
                pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([sha256(decode(i, vocabulary)).hexdigest() for i in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("key", key)
