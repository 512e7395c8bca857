"""Pairs of texts by exact similarity of their word shingles: the second pass of operator 5.

Texts are sets of hashed shingles. Texts that agree on one of BANDS bands
of ROWS min-hashes meet in a bucket; a pair at similarity 0.8 misses all of them
with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million. At first each text
is compared with one member of the largest component that it meets in a bucket; then, in
rounds with ever more members, texts of different components are, until each such pair
has been. A pair links when the Jaccard similarity of its whole sets is high enough.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import connected_components, discard, materialise, maybe_broadcast

#: Bands that two texts may meet in, and min-hashes that must agree in one.
BANDS, ROWS = 32, 5
#: Shingles that are permuted at once: BANDS * ROWS columns of them stay in a core's cache.
CHUNK = 256
#: Words of a set's parity sketch.
MARKS = 8
#: Pairs that are verified in one cell on average, and rounds at first of one pair for each text.
CELL, STARS = 4096, 1
_draw = np.random.default_rng(42)
_TURN, _FOLD = (_draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
_BAND = _draw.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, repeats included; a text of fewer words is
    one shingle, a text without words has none. Only ASCII letters change their case, only
    ASCII white space parts words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts]).tolist()
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], seed) for a, b in zip(starts, (ends[-n:] - 1).tolist())], np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band of min-hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(shingles), CHUNK):
        np.minimum(low, (shingles[k:k + CHUNK, None] * _TURN).min(0), out=low)
    x = low ^ (low >> np.uint64(29))
    x = (x * _FOLD).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + _BAND
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 64 * MARKS hashed classes: sets that differ in n
    shingles differ in n bits at most."""
    odd = np.bincount((shingles >> np.uint64(64 - 6 - MARKS.bit_length() + 1)).astype(int), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the materialised pairs (a, b) those whose sets are ``least`` similar.

    Pairs are dealt to the cells of a square, CELL of them each on average, by the hashes of both
    nodes, so that a cell is sent each set once, however many of its pairs hold it."""
    side = max(1, math.ceil(math.sqrt(pairs.count() / CELL)))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    pairs = pairs.select((at("a") * side + at("b")).cast("int").alias("cell"), "a", "b")
    sent = pairs.select("cell", F.col("a").alias("node")).union(pairs.select("cell", "b")).distinct().join(sets, "node")
    sent = sent.select((F.col("cell") + 0).alias("cell"), "node", "ids")  # a column of its own, for the sake of cogroup()

    def check(pairs: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        ids = {n: np.frombuffer(x, np.uint64) for n, x in zip(sent.node, sent.ids)}
        ok = []
        for a, b in zip(pairs.a, pairs.b):
            few, many = sorted((len(ids[a]), len(ids[b])))
            ok.append(few >= least * many and similarity(ids[a], ids[b]) >= least)
        return pairs.loc[np.array(ok, bool), ["a", "b"]]

    return pairs.groupBy("cell").cogroup(sent.groupBy("cell")).applyInPandas(check, "a long, b long")


def _sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, ids): the sorted set of shingles of each node, from the text of its holder."""
    def listed(batches):
        for b in batches:
            yield pd.DataFrame({"node": b.node, "ids": [np.unique(shingle_hashes(t, words)).tobytes() for t in b.text]})

    holders = materialise(nodes.select("node", F.col("holder.doc_id").alias("h_id"), F.col("holder.key").alias("h_key")))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    held = texts.join(maybe_broadcast(holders, holders.count(), 48), same)
    return materialise(held.select("node", "text").mapInPandas(listed, "node long, ids binary").dropDuplicates(["node"]))


def links(nodes: DataFrame, texts: DataFrame, first: DataFrame, words: int, least: float) -> DataFrame:
    """(node, root) of the nodes that have a link, the root being the smallest node of the
    component.

    nodes: (node, holder, bands, marks, size), the holder being the document (doc_id, key) whose
    text the node's set comes from, marks its parity sketch and size its number of shingles; texts: (doc_id, key, text); first: pairs (a, b) to be verified
    before any others. A hot bucket is not worked off by pairs: once its texts are connected
    with each other, no pair within a component is looked at."""
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    met = nodes.select("node", F.explode("bands").alias("k"))
    shared = met.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    member = met.join(shared, "k").groupBy("node").agg(F.collect_list("k").alias("ks"))  # BANDS at most
    member = materialise(member.join(nodes.select("node", "marks", "size"), "node"))
    few = materialise(member.select("node").union(first.select("a")).union(first.select("b")).distinct())
    sets = _sets(nodes.join(maybe_broadcast(few, few.count(), 16), "node", "left_semi"), texts, words)
    tested, found = first, materialise(_verified(first, sets, least))
    roots = materialise(connected_components(found))
    for turn in count():
        # buckets of several components, the largest of them, and a member of that
        own = member.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "marks", F.col("size").alias("shingles"), F.explode("ks").alias("k"))
        parts = own.groupBy("k", "root").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("one"))
        per = parts.groupBy("k").agg(F.max(F.struct("size", "root", "one")).alias("most"), F.sum("size").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        per = per.select("k", "n", F.col("most.size").alias("size"), F.col("most.root").alias("main"), F.col("most.one.node").alias("rep"))
        own = materialise(own.join(per, "k"))
        most = own.agg(F.max("n")).first()[0]
        if most is None:
            break
        rest = own.where("root <> main")
        reps = 16 ** max(0, 2 * (turn - STARS) + 1)
        if turn < STARS:  # each text with a member of the largest component that it meets
            star = rest.groupBy("node").agg(F.max(F.struct("size", "rep")).alias("to")).select("node", F.col("to.rep").alias("rep"))
            pairs = star.select(*ordered("node", "rep"))
        else:  # texts of the largest component meet no others of it: one side has the rest only
            rest = rest.select(F.col("k").alias("of"), "n", F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("marks").alias("other_marks"),
                               F.col("shingles").alias("other_shingles"))
            drawn = lambda c: F.pmod(F.xxhash64(c, F.lit(reps)), F.col("n")) < reps  # noqa: E731, B023
            both = F.col("shingles") + F.col("other_shingles")
            differ = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("other_marks")[i])) for i in range(MARKS))
            # the join returns only pairs that sizes and sketches cannot rule out
            meet = (F.col("of") == F.col("k")) & (F.col("root") != F.col("other_root")) & (differ <= F.floor(both * ((1 - least) / (1 + least)) + 1e-6)) & (
                F.least("shingles", "other_shingles") >= F.greatest("shingles", "other_shingles") * least - 1e-6)
            by_all = rest.drop("n").join(own.where(drawn("node")), meet)
            by_rest = rest.where(drawn("other")).drop("n").join(own.where("root = main"), meet)
            pairs = by_all.select(*ordered("node", "other")).union(by_rest.select(*ordered("node", "other")))
        pairs = materialise(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        new = materialise(_verified(pairs, sets, least))
        old = [tested, own, pairs]
        tested = materialise(tested.union(pairs))
        if not new.isEmpty():
            old += [found, roots, new]
            found = materialise(found.union(new))
            roots = materialise(connected_components(found))
        discard(*old)
        if turn >= STARS and reps >= most:
            break
    return roots
