"""SimHash near-duplicates by vantage-point trees (operator 5).

A fingerprint is cut into BLOCKS blocks of bits. Fingerprints that differ in ``reach``
bits differ in at most reach // BLOCKS bits of some block, so each block has a
vantage-point tree over the Hamming distance of its bits. Distinct fingerprints are
dealt to the leaves of the trees. A fingerprint has one home leaf in each; where its ball
crosses a boundary it also visits the leaf beyond, so that every linked
pair meets in one leaf. A leaf searches its own tree over whole fingerprints, prunes branches
by the triangle inequality, and returns a spanning forest of its links, not all pairs.

Why blocks: distances of whole fingerprints crowd around 32 of 64, and a ball of 4 bits
crosses most boundaries; a ball of one bit in 21 crosses fewer, so copies grow more slowly.

near_texts() goes on from there to all texts at a similarity of their shingles: the
links are verified, and a second pass finds pairs whose fingerprints lie further apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelq.llm import shingles
from labelq.llm.common import connected_components, materialise, only_first, small_batches, table, text_key, without

#: Blocks that fingerprints are cut into.
BLOCKS = 3
#: Pairs that are compared at once, and points of a leaf that are compared without parting them.
CELLS, LEAF = 1 << 20, 1 << 16
#: Fingerprints that live in a leaf on average; of the sample that vantage points come from
#: for each leaf, and of the sample at least and at most.
SHARD, SAMPLE_PER_SHARD, SAMPLE, SAMPLE_MOST = 2048, 32, 8192, 1 << 18
#: Points that are tried as a vantage point, and levels of a tree at most.
TRIED, LEVELS = 8, 40


def block_of(points: np.ndarray, k: int) -> np.ndarray:
    """Bits of block ``k`` of each fingerprint."""
    low, high = k * 64 // BLOCKS, (k + 1) * 64 // BLOCKS
    return (points >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Majority of each bit over the hashes of a text's shingles; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k:k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 without words."""
    return fingerprint_of(shingles.shingle_hashes(text, words, seed))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose(points: np.ndarray, home: np.ndarray, reach: int) -> tuple[int, int] | None:
    """Vantage point and radius that part the home points with the fewest visitors for what the
    parting tells (copies against the entropy of the two sides); None if nothing parts them.

    Only which points are compared depends on the choice, never which pairs are found."""
    own = points[home]
    best = None
    for v in own[np.linspace(0, len(own) - 1, min(TRIED, len(own))).astype(int)] if len(own) > 3 else ():
        within = np.cumsum(np.bincount(_distance(own, v), minlength=65)) / len(own)
        p = within[:64]
        radius = np.arange(64)
        crossed = within[np.minimum(radius + reach, 64)] - np.where(radius >= reach, within[radius - reach], 0)
        told = -(p * np.log(np.maximum(p, 1e-9)) + (1 - p) * np.log(np.maximum(1 - p, 1e-9)))
        cost = np.where((p >= 0.05) & (p <= 0.95), (np.log1p(crossed) + 0.01) / np.maximum(told, 1e-9), np.inf)
        at = int(cost.argmin())
        if cost[at] < np.inf and (best is None or cost[at] < best[0]):
            best = (cost[at], int(v), at)
    return best and best[1:]


def _part(points, home, at, split, reach):
    """(indices, home) of the two sides. A pair across the boundary is found within it: of home
    points only those outside come along."""
    d = _distance(points[at], np.uint64(split[0])).astype(int)
    near = d <= split[1]
    inner = near | (d <= split[1] + reach)
    outer = ~near | (~home & (d > split[1] - reach))
    return (at[inner], (home & near)[inner]), (at[outer], (home & ~near)[outer])


def build_tree(sample: np.ndarray, n: int, reach: int, shard: int = SHARD) -> dict[int, tuple[int, int]]:
    """(vantage point, radius) of each inner node; node i has children 2i + 1 (within) and
    2i + 2. A node is parted until about ``shard`` of ``n`` points, by the sample, live in it,
    or until nothing parts it."""
    tree = {}
    todo = [(0, 0, np.sort(sample))]
    while todo:
        node, level, points = todo.pop()
        if level >= LEVELS or len(points) * n <= shard * len(sample) or len(points) < SAMPLE_PER_SHARD // 2:
            continue
        split = choose(points, np.ones(len(points), bool), reach)
        if split is None:
            continue
        tree[node] = split
        near = _distance(points, np.uint64(split[0])) <= split[1]
        todo += [(2 * node + 1, level + 1, points[near]), (2 * node + 2, level + 1, points[~near])]
    return tree


def deal(points: np.ndarray, tree: dict, reach: int):
    """(leaf, index, home) of every leaf that each point lives in or visits."""
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    out = []
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node not in tree:
            out.append((np.full(len(at), node), at, home))
            continue
        for k, side in enumerate(_part(points, home, at, tree[node], reach)):
            todo.append((2 * node + 1 + k, *side))
    if not out:
        return (np.zeros(0, int),) * 2 + (np.zeros(0, bool),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the index of a point that is its own label) after linking a with b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def link_forest(points: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """For each point the index of a point that it is connected to through links
    between home points, or of home points to visitors; equal numbers: connected."""
    label = np.arange(len(points))
    todo = [(np.arange(len(points)), home)]
    while todo:
        at, at_home = todo.pop()
        own = at[at_home]
        if not len(own):
            continue
        split = choose(points[at], at_home, reach) if len(at) > LEAF else None
        if split is not None:
            todo += _part(points, at_home, at, split, reach)
            continue
        base = points[at]
        step = max(1, CELLS // len(at))
        for k in range(0, len(own), step):
            some = own[k:k + step]
            i, j = np.nonzero(_distance(points[some][:, None], base[None, :]) <= reach)
            label = _unite(label, some[i], at[j])
    return label


def tree_links(prints: DataFrame, reach: int = 4) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``prints`` (fp) that connect all that are at
    ``reach`` or fewer differing bits. No fingerprints give no rows."""
    n = prints.count()
    size = min(SAMPLE_MOST, max(SAMPLE, SAMPLE_PER_SHARD * -(-n // SHARD)))
    share = min(1.0, 2.0 * size / max(n, 1))  # a threshold on the hash: no task sorts all fingerprints
    few = prints.where(F.xxhash64("fp") / 2.0 ** 64 + 0.5 <= share)
    sample = few.orderBy(F.xxhash64("fp"), "fp").limit(size).select("fp").toPandas().fp.to_numpy(np.int64).view(np.uint64)
    near = reach // BLOCKS
    trees = [build_tree(block_of(sample, k), n, near) for k in range(BLOCKS)]

    def shard(batches):
        for b in batches:
            fp = b.fp.to_numpy(np.int64)
            for k in range(BLOCKS):
                leaf, at, home = deal(block_of(fp.view(np.uint64), k), trees[k], near)
                yield pd.DataFrame({"tree": np.full(len(at), k, np.int8), "leaf": leaf, "fp": fp[at], "home": home})

    def links(pdf):
        fp = pdf.fp.to_numpy(np.int64)
        label = link_forest(fp.view(np.uint64), pdf.home.to_numpy(bool), reach)
        moved = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

    dealt = prints.select("fp").mapInPandas(shard, "tree byte, leaf long, fp long, home boolean")
    return dealt.groupBy("tree", "leaf").applyInPandas(links, "a long, b long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", text_key("text"))


def _first() -> Column:
    """The first document of a group: a document without an id comes last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))


def _named(rows: DataFrame, nodes: DataFrame, roots: DataFrame, node: str, *more: str) -> DataFrame:
    """``rows`` with the smallest id of their component and its first document (id, key).
    nodes: (node, holder), roots: (node, root) of nodes that have a link."""
    named = nodes.join(roots.toDF("__node", "__root"), F.col(node) == F.col("__node"), "left").select(node, "holder", F.coalesce("__root", node).alias("root"))
    first = named.groupBy("root").agg(F.min("holder").alias("first"))
    named = named.join(first, "root").select(node, "first")
    return rows.join(named, node).select("doc_id", "key", *more, F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 4, reach: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the
    smallest id reachable through fingerprints at ``reach`` or fewer differing bits;
    key and first_key are the digests of the document's text and of the first one's.

    Null and empty texts have fingerprint zero and link like any other. Equal
    rows each get a row; a null id comes last. An empty table gives no rows; other columns are ignored.
    The tree's vantage points come from a sample of at most SAMPLE_MOST fingerprints,
    which decides where points are compared and never which pairs are found."""
    small_batches(docs.sparkSession)

    def prints(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "key": b.key, "fp": np.array([fingerprint(t, words) for t in b.text], np.uint64).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    fps = materialise(_texts(docs, id_col, text_col).select("doc_id", "key", "text").mapInPandas(prints, f"doc_id {kind}, key long, fp long"))
    nodes = materialise(fps.groupBy("fp").agg(_first().alias("holder")))
    roots = connected_components(tree_links(nodes.select("fp"), reach))
    named = _named(fps, nodes, roots, "fp", "fp")
    return named.select("doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "first_key")


def near_texts(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, least: float = 0.8, reach: int = 4) -> DataFrame:
    """One row per document: id, key, component_id and first_key as near_duplicates() gives
    them, for texts whose sets of ``words``-word shingles are at Jaccard similarity
    ``least`` or more.

    Fingerprints within ``reach`` bits of each other are candidates, found by the vantage-point
    tree. At a similarity of 0.8 fingerprints differ by 10 of 64 bits on average, which a tree
    cannot search without reading nearly all of it: shingles.links() finds those pairs. Every
    link is verified on whole sets.

    Words are split at white space, ASCII letters in lower case. A text of fewer than ``words``
    words is one shingle; null texts and texts without words are alike. Equal
    rows each get a row; a null id comes last. An empty table gives no rows; other columns are ignored."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)

    def signed(batches):
        for b in batches:
            hashes = [shingles.shingle_hashes(t, words) for t in b.text]
            sets = [np.unique(h) for h in hashes]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id, "key": b.key, "node": node, "fp": fp, "bands": [shingles.band_keys(s).view(np.int64) for s in sets],
                                "marks": [shingles.parity(s) for s in sets], "size": [len(s) for s in sets]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(texts.select("doc_id", "key", "text").mapInPandas(signed, f"doc_id {kind}, key long, node long, fp long, bands array<long>, marks array<long>, size long"))
    nodes = materialise(rows.groupBy("node").agg(_first().alias("holder"), *(F.first(c).alias(c) for c in ("bands", "marks", "size"))))
    # texts that share a fingerprint, and those whose fingerprints the tree links
    held = rows.select("fp", "node").distinct()
    prints = materialise(held.groupBy("fp").agg(F.min("node").alias("rep")))
    near = tree_links(prints.select("fp"), reach)
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_node"))
    linked = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("x"), F.col("b_node").alias("y"))
    pairs = held.join(prints, "fp").select(F.col("node").alias("x"), F.col("rep").alias("y")).union(linked)
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    roots = shingles.links(nodes, texts, materialise(pairs), words, least)
    return _named(rows, nodes.select("node", "holder"), roots, "node")


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", find=near_duplicates, **kw) -> DataFrame:
    """One document of each group that ``find`` tells, with every column: the one of smallest
    id, then of smallest text digest; a null id comes last. Ids may repeat: documents are told
    apart by id and text, and of rows alike in both one stays."""
    found = materialise(find(docs, id_col, text_col, **kw).select("doc_id", "key", "component_id", "first_key"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key"))
    kept = without(docs, found.where(~first).select("doc_id", "key"), id_col, text_col)
    repeated = found.where(first).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    return only_first(kept, repeated, id_col, text_col)


def op5_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
