"""Line deduplication by a segment-partition edit join (operator 1).

Two lines within ``EDITS`` edits share one of EDITS + 1 segments of the shorter
one unchanged, at a place that the edits bound. Lines are indexed by their
segments, probe with the substrings that could be such a segment, for every
length that is near enough. Pairs whose bigram sketches differ by more than the
edits can explain go at once; the others are verified by edit distance in a band,
bit-parallel over the band and vectorised over pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from labelq.llm.common import maybe_broadcast, materialise, small_batches, table

#: Edits that a duplicate may differ by, and characters of the lines that are judged at least.
EDITS, MIN_CHARS = 2, 20
#: Characters of the pairs that are verified at once, and pairs that are gathered for it.
VERIFY_CELLS, VERIFY_ROWS = 1 << 22, 8192


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments, whose lengths differ by one at most."""
    base, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = base + (i >= edits + 1 - more)
        out.append((at, n))
        at += n
    return out


def probe_plan(length: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(seed, start, length) of the substrings of a line that may be a segment of a line
    as long or up to ``edits`` shorter: where the parts left and right of the segment
    can absorb no more edits than remain."""
    out = []
    for short in range(max(edits + 1, length - edits), length + 1):
        more = length - short
        for i, (at, n) in enumerate(segments(short, edits)):
            low = max(0, at - i, at + more - (edits - i))
            high = min(length - n, at + i, at + more + (edits - i))
            out += [(short * (edits + 1) + i, start, n) for start in range(low, high + 1)]
    return out


def index_plan(length: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    return [(length * (edits + 1) + i, at, n) for i, (at, n) in enumerate(segments(length, edits))]


def within(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Edit distance of each pair, or edits + 1 where it is more.

    Bit b of a word stands for row (column - edits + b) of the pair's matrix; the
    words follow the diagonal, so that 2 * edits + 1 bits hold the band."""
    out = np.full(len(left), edits + 1)
    pairs = sorted((max(len(a), len(b)), k) for k, (a, b) in enumerate(zip(left, right)) if abs(len(a) - len(b)) <= edits)
    while pairs:
        n = 1
        while n < len(pairs) and (n + 1) * (pairs[n][0] + 1) <= VERIFY_CELLS:
            n += 1
        ids, pairs = [k for _, k in pairs[:n]], pairs[n:]
        out[ids] = _band([left[k] for k in ids], [right[k] for k in ids], edits)
    return np.minimum(out, edits + 1)


def _codes(texts: list[str], height: int, fill: int) -> np.ndarray:
    m = np.full((len(texts), height), fill, np.uint32)
    for k, t in enumerate(texts):
        m[k, :len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(m.T)


def _band(a: list[str], b: list[str], edits: int) -> np.ndarray:
    a, b = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)))
    n = np.array([len(y) for y in b])
    gap = n - np.array([len(x) for x in a])
    height = int(n.max(initial=0))
    rows = _codes(list(a), height + 2 * edits + 1, 0xFFFFFFFF)   # one code for padding on each side: no match
    cols = _codes(list(b), height, 0xFFFFFFFE)
    one, mask = np.uint64(1), np.uint64((1 << (2 * edits + 1)) - 1)
    vp = np.full(len(a), ((1 << (edits + 1)) - 1) << edits, np.uint64)
    vn = np.zeros(len(a), np.uint64)
    end = (edits - gap).astype(np.uint64)                        # the diagonal that ends in the last cell
    distance = gap.copy()
    for j in range(1, height + 1):
        c = cols[j - 1]
        eq = np.zeros(len(a), np.uint64)
        for bit in range(2 * edits + 1):
            row = j - edits + bit
            if row >= 1:
                eq |= (rows[row - 1] == c).astype(np.uint64) << np.uint64(bit)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        distance += ((d0 >> end) & one == 0) & (j > gap) & (j <= n)
        hp = hp << one | one
        vp = ((((hn << one) | ~(d0 | hp)) & mask) >> one) | np.uint64(1 << (2 * edits))
        vn = ((hp & d0) & mask) >> one
    return distance


def _bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One of 64 bits for each bigram of code points."""
    h = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return np.uint64(1) << (h >> np.uint64(58))


#: The bits of all bigrams of the first 256 code points.
_LATIN = _bits(np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255)


def sketches(text: str) -> tuple[list[str], np.ndarray]:
    """Lines of a text and, for each, the parity of its character bigrams in 64 hashed
    classes. An edit takes away or adds at most two bigrams each way, so it flips at most
    four bits."""
    try:
        code = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.flatnonzero(code == 10)
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(code)]))
    bits = np.zeros(len(code) + 1, np.uint64)
    if len(code) > 1:
        bits[:len(code) - 1] = _LATIN[(code[:-1].astype(np.uint16) << np.uint16(8)) | code[1:]] if code.dtype == np.uint8 else _bits(code[:-1], code[1:])
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > 1)
    if len(long):
        out[long] = np.bitwise_xor.reduceat(bits, np.stack((starts[long], ends[long] - 1), 1).ravel())[::2]
    return text.split("\n"), out


def _parts(texts, most: int = 1 << 20):
    """The lines of all texts, in lists of about ``most`` characters."""
    held, size = [], 0
    for text in texts:
        for line in text.split("\n"):
            held.append(line)
            size += len(line)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _plan(length: int) -> list[tuple[int, int, int]]:
    return [*index_plan(length), *probe_plan(length)]


def _keys():
    """Rows (k, id, mark, probe) of the segments and of the probes of every judged line."""
    plans: dict = {}

    def run(batches):
        seen: set = set()  # a line that a task has met already adds nothing
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys, ids, marks, counts = [], [], [], []
            for line, mark in (x for part in _parts(batch.text) for x in zip(*sketches("\n".join(part)))):
                n = len(line)
                if n < MIN_CHARS:
                    continue
                raw = line.encode("utf-8", "surrogatepass")
                i = digest(raw, 42)  # what xxhash64() gives
                if i in seen:
                    continue
                seen.add(i)
                if n not in plans:
                    if len(plans) > 65536:
                        plans.clear()
                    plans[n] = _plan(n)
                if n == len(raw):
                    keys += [digest(raw[s:s + m], seed) for seed, s, m in plans[n]]
                else:
                    keys += [digest(line[s:s + m].encode("utf-8", "surrogatepass"), seed) for seed, s, m in plans[n]]
                ids.append(i)
                marks.append(mark)
                counts.append(len(plans[n]))
            again = lambda x: np.repeat(np.array(x, np.uint64), counts).view(np.int64)
            probe = np.ones(len(keys), bool)
            first = np.cumsum(counts, dtype=int) - counts
            for i in range(EDITS + 1):  # a line's segments stand first
                probe[first + i] = False
            yield pd.DataFrame({"k": np.array(keys, np.uint64).view(np.int64), "id": again(ids), "mark": again(marks), "probe": probe})

    return run


def _lines(d: DataFrame) -> DataFrame:
    """Judged lines: doc_id, key, no, line."""
    return d.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.length("line") >= MIN_CHARS)


def _text(c) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("text"))
    return d.withColumn("key", F.xxhash64("text"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers."""
    def cut(text, numbers):
        numbers = {*numbers}
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in numbers)

    return pd.Series([t if g is None or not len(g) else cut(t, g) for t, g in zip(texts, gone)], dtype=object)


def line_links(d: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs (a, b, distance) of the ids, xxhash64 of the line, of different judged
    lines within EDITS edits of each other; d: rows (doc_id, key, text), firsts: id
    and place of first occurrence of each judged line."""
    # Both sides read one exchange. The random column keeps the filter that tells them apart above
    # it; below, it would have the texts cut up once for each side.
    rows = d.select("text").mapInPandas(_keys(), "k long, id long, mark long, probe boolean").repartition("k").withColumn("above", F.rand(0))
    side = lambda probe: rows.where((F.col("probe") == probe) & (F.col("above") >= 0)).select("k", "id", "mark").distinct()
    probe = side(True).withColumnsRenamed({"id": "other", "mark": "other_mark"})
    near = F.bit_count(F.col("mark").bitwiseXOR(F.col("other_mark"))) <= 4 * EDITS
    pairs = side(False).join(probe, "k").where(near & (F.col("id") != F.col("other"))).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    pairs = materialise(pairs.distinct())
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = maybe_broadcast(ids, ids.count(), 16)
    # the candidates' texts, from the documents that first hold them
    holders = materialise(firsts.join(few, "id", "left_semi").select(F.col("first.doc_id").alias("h_id"), F.col("first.key").alias("h_key")).distinct())
    held = d.join(maybe_broadcast(holders, holders.count(), 32), d.doc_id.eqNullSafe(F.col("h_id")) & (d.key == F.col("h_key")), "left_semi")
    texts = materialise(_lines(held).select(F.xxhash64("line").alias("id"), "line").join(few, "id", "left_semi").distinct())
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")

    def verify(batches):
        held: list = []

        def flush():
            p = pd.concat(held, ignore_index=True)
            p = p.assign(distance=within(list(p.line_a), list(p.line_b)))
            return p.loc[p.distance <= EDITS, ["a", "b", "distance"]]

        for p in batches:  # many pairs at once: the columns of the band are worked off together
            held.append(p)
            if sum(map(len, held)) >= VERIFY_ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    return both.select("a", "b", "line_a", "line_b").mapInPandas(verify, "a long, b long, distance int").groupBy("a", "b").agg(F.min("distance").alias("distance"))


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, row (all columns of ``docs``), kept (the text
    without its duplicate lines), n_lines, n_removed and n_links (other line texts within EDITS edits of its
    judged lines, summed over the lines).

    Lines end at a line feed; lines of MIN_CHARS characters or more are judged, and
    shorter ones always stay. A judged line goes when the same line, or one within
    EDITS edits whose first occurrence is earlier, occurs earlier: in order of doc_id,
    then of xxhash64 of the text, then of the line's number. Rows alike in id and
    text are one document and get one answer. A null text is empty: one line, kept.
    A null id comes first. An empty table gives no rows; other columns are ignored."""
    small_batches(docs.sparkSession)
    d = _rows(docs, id_col, text_col)
    places = materialise(_lines(d).select("doc_id", "key", "no", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("check")))
    spot = F.struct("doc_id", "key", "no")
    firsts = materialise(places.groupBy("id", "check").agg(F.min(spot).alias("first"), F.count("*").alias("n")))
    links = materialise(line_links(d, firsts))
    either = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
    first_of = firsts.groupBy("id").agg(F.min("first").alias("first"))
    near = either.join(first_of, "id").join(first_of.select(F.col("id").alias("other"), F.col("first").alias("other_first")), "other")
    near = near.groupBy("id").agg(F.count("*").alias("links"), F.max(F.col("other_first") < F.col("first")).alias("later"))
    told = firsts.join(near.withColumnRenamed("id", "near_id"), F.col("id") == F.col("near_id"), "left").where("n > 1 or links > 0")
    told = told.select("id", "check", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("later", F.lit(False)).alias("later"))
    marks = places.join(told, ["id", "check"]).withColumn("gone", F.col("later") | (spot != F.col("first")))
    # rows alike in id and text bring the same lines: each counts once
    marks = marks.groupBy("doc_id", "key").agg(F.collect_set(F.struct("no", "gone", "links")).alias("marks"))
    marks = marks.select("doc_id", "key", F.transform(F.filter("marks", lambda m: m["gone"]), lambda m: m["no"]).alias("gone"),
                         F.aggregate("marks", F.lit(0).cast("long"), lambda n, m: n + m["links"]).alias("n_links"))
    marks = marks.select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), "gone", "n_links")
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    own, text = F.col("row")[id_col], _text(F.col("row")[text_col])
    out = whole.join(marks, own.eqNullSafe(F.col("m_id")) & (F.xxhash64(text) == F.col("m_key")), "left")
    once = _without.asNondeterministic()  # else a filter on the result runs it a second time
    removed = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    return out.select(own.alias("doc_id"), "row", once(text, F.col("gone")).alias("kept"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
                      removed.alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("kept", 256).alias("kept_sha256"))


def distance(a: str, b: str) -> int:
    """Edit distance by the whole matrix, for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_removed, n_links, kept) of rows (doc_id, text) with different ids, for tests."""
    first: dict[str, tuple] = {}
    for i, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= MIN_CHARS:
                first.setdefault(line, (i, no))
    near = {x: [y for y in first if y != x and abs(len(x) - len(y)) <= EDITS and distance(x, y) <= EDITS] for x in first}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(x) >= MIN_CHARS and (first[x] != (i, no) or any(first[y] < first[x] for y in near[x])) for no, x in enumerate(lines)]
        out.append((i, sum(gone), sum(len(near[x]) for x in lines if len(x) >= MIN_CHARS), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out
