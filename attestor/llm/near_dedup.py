"""Near duplicates by an inverted join over MinHash signature coordinates.

A document's set holds its distinct shingles of ``width`` words (a text with fewer words is one
shingle; no words, no set). Shingles are 64-bit hashes, sets are told apart by 128-bit digests.

1. Every document gets a signature of ``COORDS`` coordinates, each of ``MINIMA`` minima at once, so
   that two documents agree in one with their similarity to that power: documents that only share
   common phrases hardly ever do. Equal sets share one node.
2. Nodes are posted under (coordinate, value) tokens. Two nodes at the threshold agree in at least
   ``match_floor`` coordinates (7 of 32 at 0.8) but with probability ``MISS``, so it suffices to
   post each node under its ``COORDS - match_floor + 1`` rarest tokens (prefix merging); tokens
   that only one node has fill up the prefix but are not posted. Unrelated documents rarely meet.
3. Pairs come from short lists; a long list offers each member only its most central member.
   Of all pairs, those whose signatures agree in that many coordinates are compared on full sets.
4. Members of a long list that are linked by now are skipped; the others are compared with the
   list's members of other components, exactly and in blocks of bounded rows and bounded shingles, and
   at most one link per member and component leaves a block (skip merging). No group is ever listed
   as pairs.
5. Components come from contracting links until none is left.

Links ask for ``100 * intersection >= percent * union``. Null and empty texts have no set and are
linked with nothing. Repeated rows share their node. Rows with a null key get a component like any
other (the smallest non-null key, null if there is none). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.llm.common import Workspace, bounded_batches, by_size, text_bytes

WIDTH, PERCENT = 5, 80
COORDS, MINIMA = 32, 2
MISS = 1e-6
SHORT_LIST = 16
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
CACHED_WORDS = 400_000

_seeds = np.random.default_rng(20_240_229)
_FACTORS = _seeds.integers(0, 2**63, (COORDS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _seeds.integers(0, 2**63, (COORDS, MINIMA), dtype=np.uint64)


def match_floor(percent: int) -> int:
    """Most coordinates that a pair at the threshold reaches but with probability ``MISS``."""
    p, below, least = (percent / 100) ** MINIMA, 0.0, 0
    while least < COORDS - 1:
        below += comb(COORDS, least) * p**least * (1 - p) ** (COORDS - least)
        if below > MISS:
            break
        least += 1
    return max(least, 1)


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(data: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z count as a-z."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(members: np.ndarray) -> np.ndarray:
    out = np.zeros(COORDS, np.uint64)
    for m in range(MINIMA):
        lowest = np.array([(members * a + b).min() for a, b in zip(_FACTORS[:, m], _SHIFTS[:, m])], np.uint64)
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + lowest
    return out


def set_digest(members: np.ndarray) -> bytes:
    return blake2b(members.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row: key, n_shingles, node (digest of the set, null without words), sig."""
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, nodes, sigs = [], [], []
            for value in batch.column(1):
                members = shingle_set(value.as_py(), width, hashes)
                counts.append(len(members))
                nodes.append(set_digest(members) if len(members) else None)
                sigs.append(signature(members).view(np.int64) if len(members) else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_shingles", "node", "sig"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_shingles bigint, node binary, sig array<bigint>")


def post(nodes: DataFrame, percent: int) -> DataFrame:
    """Prefix postings: tok, node, pop (how common the node's tokens are)."""
    tokens = nodes.select("node", F.posexplode("sig").alias("coord", "value")).select("node", F.xxhash64("coord", "value").alias("tok"))
    shared = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    per_node = tokens.join(shared, "tok").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("shared"), F.sum(F.log("df")).alias("pop")
    )
    # Tokens of this node alone come first in its prefix and need no posting.
    room = F.size("shared") - F.lit(match_floor(percent) - 1)
    posted = per_node.where(room > 0).select("node", "pop", F.explode(F.slice("shared", F.lit(1), room)).alias("t"))
    return posted.select(F.col("t.tok").alias("tok"), "node", "pop")


def agreeing_pairs(postings: DataFrame, lists: DataFrame, nodes: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Pairs of short lists and (member, centre) pairs of long ones whose signatures agree."""
    # Staged, because inner joins may be reordered: postings must never meet postings in long lists.
    short = space.put("short", postings.join(lists.where(F.col("n") <= SHORT_LIST).select("tok"), "tok").select("tok", "node"))
    other = short.select("tok", F.col("node").alias("b"))
    close = short.join(other, "tok").where(F.col("node") < F.col("b")).select(F.col("node").alias("a"), "b")
    spokes = postings.join(lists.where(F.col("n") > SHORT_LIST).select("tok", "centre"), "tok").where("node != centre")
    spokes = spokes.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    pairs = close.unionByName(spokes).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    met = pairs.join(left, "a").join(right, "b")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return met.where(sizes & (agree >= match_floor(percent))).select("a", "b")


def fetch_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Sets of the wanted (node, label) rows, computed again from the text of document ``label``."""
    named = wanted.where("label is not null").select(F.col("label").alias("key"), F.col("node").alias("wanted"))
    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("text"))
    texts = rows.join(by_size(named), "key").select("text", "wanted")
    # Nodes of rows without a key can only be found by their set.
    loose = rows.where("key is null").select("text", F.lit(None).cast("binary").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for value, expected in zip(batch.column(0), batch.column(1).to_pylist()):
                members = shingle_set(value.as_py(), width, hashes)
                node = set_digest(members)
                if len(members) and expected in (None, node):
                    nodes.append(node)
                    sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "members"])

    schema = "node binary, members binary"
    found = texts.mapInArrow(run, schema)
    unnamed = loose.mapInArrow(run, schema).join(wanted.where("label is null").select("node"), "node", "left_semi")
    return found.unionByName(unnamed).dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, space: Workspace, tag: str) -> DataFrame:
    """Per linked node: node, root (the component's smallest node).

    Every round hooks each node to its smallest neighbour, shortens that chain once, and replaces
    links by links between roots; a round leaves at most half of the nodes that still have links.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = space.put(f"{tag}_edges0", both.distinct())
    roots: DataFrame | None = None
    step = 0
    while roots is None or not edges.isEmpty():
        step += 1
        hooked = space.put(f"{tag}_hooked{step}", edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        above = hooked.select(F.col("a").alias("up"), F.col("up").alias("top"))
        parents = hooked.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("root"))
        parents = space.put(f"{tag}_parents{step}", parents)
        if roots is None:
            roots = parents.select(F.col("a").alias("node"), "root")
        else:
            moved = parents.select(F.col("a").alias("root"), F.col("root").alias("top"))
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = space.put(f"{tag}_roots{step}", roots)
        other = parents.select(F.col("a").alias("b"), F.col("root").alias("root_b"))
        edges = edges.join(parents, "a").join(other, "b").where("root != root_b")
        edges = space.put(f"{tag}_edges{step}", edges.select(F.col("root").alias("a"), F.col("root_b").alias("b")).distinct())
    return roots


def _block_links(percent: int):
    """Compare one block of open members with one block of members; few links leave it."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        if len(left) and len(right):
            rows = [np.frombuffer(m, np.uint64) for m in left["members"]]
            others = [np.frombuffer(m, np.uint64) for m in right["members_r"]]
            # Only shingles of at least two different sets can meet; most of a copy's changes are its own.
            different = dict(zip([*left["node"], *right["node_r"]], [*rows, *others]))
            every, counts = np.unique(np.concatenate(list(different.values())), return_counts=True)
            vocabulary = every[counts > 1]
            shared = np.zeros((len(rows), len(others)), np.float32)
            for start in range(0, len(vocabulary), 4096):
                part = vocabulary[start : start + 4096]
                shared += _incidence(rows, part) @ _incidence(others, part).T
            sizes = np.array([len(x) for x in rows])[:, None] + np.array([len(x) for x in others])[None, :]
            roots, others_roots = left["root"].to_numpy(), right["root_r"].to_numpy()
            linked = (100 * shared >= percent * (sizes - shared)) & (roots[:, None] != others_roots[None, :])
            for i in np.flatnonzero(linked.any(1)):
                first: dict[bytes, int] = {}
                for j in np.flatnonzero(linked[i]):
                    first.setdefault(others_roots[j], j)
                found += [(left["node"].iat[i], right["node_r"].iat[j]) for j in first.values()]
        return pd.DataFrame(found, columns=["a", "b"])

    return compare


def _incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), np.float32)
    for i, members in enumerate(sets):
        at = np.searchsorted(members, part)
        at[at == len(members)] = 0
        out[i] = members[at] == part
    return out


def open_members(postings: DataFrame, lists: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of long lists that still hold several components: tok, node, root, open, blocks.

    ``open`` members lie outside the component of the list's centre. A list is dealt into blocks of
    about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles, whichever is reached first.
    """
    long_lists = lists.where(F.col("n") > SHORT_LIST).select("tok", "centre")
    named = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    long_lists = long_lists.join(named, "centre", "left").select("tok", F.coalesce("centre_root", "centre").alias("centre_root"))
    members = postings.select("tok", "node").join(long_lists, "tok").join(roots, "node", "left")
    members = members.select("tok", "node", F.coalesce("root", "node").alias("root"), "centre_root")
    members = members.withColumn("open", F.col("root") != F.col("centre_root")).drop("centre_root")
    members = members.join(nodes.select("node", "n_shingles"), "node")

    def blocks(wanted) -> Column:
        rows, shingles = F.count(F.when(wanted, 1)), F.sum(F.when(wanted, F.col("n_shingles")))
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(F.coalesce(shingles, F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    sizes = members.groupBy("tok").agg(blocks(F.col("open")).alias("open_blocks"), blocks(F.lit(True)).alias("all_blocks"))
    return members.drop("n_shingles").join(sizes.where("open_blocks > 0"), "tok")


def remaining_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of open members to other components of their lists, compared block by block."""
    with_sets = members.join(sets, "node")
    open_blocks, all_blocks = F.col("open_blocks"), F.col("all_blocks")
    mine = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    left = with_sets.where("open").withColumn("i", mine(open_blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), all_blocks - 1)))
    right = with_sets.withColumn("j", mine(all_blocks)).withColumn("i", F.explode(F.sequence(F.lit(0), open_blocks - 1)))
    wanted = ["tok", "i", "j", "node", "root", "members"]
    right = right.select(*[F.col(c).alias(f"{c}_r") for c in wanted])
    grouped = left.select(*wanted).groupBy("tok", "i", "j").cogroup(right.groupBy("tok_r", "i_r", "j_r"))
    return grouped.applyInPandas(_block_links(percent), "a binary, b binary").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key of its component), kept."""
    found = _grouped(docs, key, text, width, percent)
    return found.select(
        F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _grouped(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Per row: key, node, n_shingles, component_id."""
    if (1 - (percent / 100) ** MINIMA) ** COORDS > MISS:
        raise ValueError(f"{COORDS} coordinates of {MINIMA} minima would miss pairs at {percent} %")
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "near")
    signed = space.put("signed", sign(docs, key, text, width))
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min("key").alias("label"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")
    )
    nodes = space.put("nodes", nodes)
    postings = space.put("postings", post(nodes, percent))
    lists = postings.groupBy("tok").agg(F.count("*").alias("n"), F.max(F.struct("pop", "node"))["node"].alias("centre")).where("n > 1")
    lists = space.put("lists", lists)
    pairs = space.put("pairs", agreeing_pairs(postings, lists, nodes, percent, space))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = space.put("wanted", wanted.join(nodes.select("node", "label"), "node"))
    sets = space.put("sets", fetch_sets(docs, wanted, key, text, width))
    links = space.put("links", confirm(pairs, sets, percent))
    roots = components(links, space, "first")
    members = space.put("members", open_members(postings, lists, roots, nodes))
    more = members.select("node").distinct().join(nodes.select("node", "label"), "node")
    more = space.put("more", more.join(sets.select("node"), "node", "left_anti"))
    if not more.isEmpty():
        sets = sets.unionByName(space.put("more_sets", fetch_sets(docs, more, key, text, width)))
    if not members.isEmpty():
        rest = space.put("rest", remaining_links(members, sets, percent))
        upper = lambda c: F.coalesce(c, F.col("x"))
        a_root = rest.select(F.col("a").alias("x"), "b").join(roots, F.col("x") == roots["node"], "left").select(upper(F.col("root")).alias("a"), "b")
        ab_root = a_root.select("a", F.col("b").alias("x")).join(roots, F.col("x") == roots["node"], "left").select("a", upper(F.col("root")).alias("b"))
        second = components(ab_root.where("a != b"), space, "second")
        moved = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        new = second.join(roots.select("node"), "node", "left_anti")
        roots = space.put("all_roots", known.unionByName(new))
    labelled = nodes.select("node", "label").join(roots, "node", "left").select("node", "label", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("label").alias("component_id"))
    named = space.put("named", labelled.join(smallest, "root").select("node", "component_id"))
    space.close("signed", "named")
    out = signed.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select("key", "node", "n_shingles", component.alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest key.

    Rows that share a key are told apart by their sets: of a component's rows with its smallest key
    one stays, and a row whose text belongs to another component is judged there. Rows without a
    key, and those without words, always stay.
    """
    space = Workspace(docs.sparkSession, "near_copies")
    found = space.put("found", _grouped(docs, key, text, width, percent).select("key", "node", "component_id").where("key is not null"))
    gone = space.put("gone", found.where("key != component_id").select(F.col("key").alias("gone")).distinct())
    shared = space.put("shared", found.groupBy(F.col("key").alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared"))
    if shared.isEmpty():
        return docs.join(by_size(gone), docs[key] == gone["gone"], "left_anti")
    alone = docs.join(shared, docs[key] == shared["shared"], "left_anti").join(by_size(gone), docs[key] == gone["gone"], "left_anti")
    winners = found.where("key = component_id and node is not null").groupBy("key").agg(F.min("node").alias("node"))
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
    rows = docs.join(shared, docs[key] == shared["shared"], "left_semi").select(F.col(key).alias("key"), text_bytes(text).alias("text"), body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(value.as_py(), width, hashes) for value in batch.column(1)]
            nodes = pa.array([set_digest(m) if len(m) else None for m in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, batch.column(2)], ["key", "node", "body"])

    named = rows.mapInArrow(run, rows.select("key", F.lit(None).cast("binary").alias("node"), "body").schema)
    named = space.put("named", named)
    turn = F.row_number().over(Window.partitionBy("key", "node").orderBy(F.xxhash64("body")))
    best = named.where("node is not null").join(winners, ["key", "node"], "left_semi").withColumn("turn", turn).where("turn = 1")
    stay = best.select("body.*").unionByName(named.where("node is null").select("body.*"))
    return alone.unionByName(stay)


# All pairs that share a shingle, for small tables: the check of the operator with two-word shingles.
NEAR_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS sizes, count(*) AS met
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * met >= {PERCENT} * (sizes - met)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT doc_id, b FROM reach JOIN steps ON a = other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
"""
