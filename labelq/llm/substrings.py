"""Removal of repeated substrings by suffix sorting (operator 10).

Every window of 200 bytes is assigned to one 16-byte gram inside it, the one of
least hash (the leftmost of equals), so that equal windows of different
documents meet at the same gram. The stretches of text around grams that occur
more than once are suffix-sorted shard by shard with bucket-pointer refinement:
buckets of equal 8-grams are refined by the bucket pointers of the suffixes
further on. Each bucket knows how many bytes its pointer stands for; pointers that were
refined a moment ago are used at once, so the depth of a bucket grows by that of what
it points to, until it spans a window. A gram of very many stretches is refined before
that, over all tasks, by the bytes beside it. Windows are judged on the input
and covered bytes removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import materialise, maybe_broadcast, small_batches, table

WIDTH, GRAM = 200, 16
#: Text that is sorted at once (arrays of its size stay in a core's cache), parts of its buckets that
#: are refined one after the other, and different stretches that one gram has at most in a sort.
SORT_BYTES, PARTS, HOT = 1 << 16, 4, 8192
#: Bytes hashed at once; positions within must fit the packed order's low bits.
_LOW = 20
CHUNK = 1 << (_LOW - 1)
_U = np.uint64
_P = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes that start at each place."""
    h = data.astype(_U) + _U(1)
    for k, p in enumerate(_P):
        h = h[:-(1 << k)] * p + h[1 << k:]
    h ^= h >> _U(32)
    h *= _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


def stretches(data: bytes, width: int = WIDTH):
    """(start, length, hash of the gram) of the stretches that cover all windows of
    ``data``: each holds the consecutive windows of one gram."""
    if len(data) < width:
        return
    whole = np.frombuffer(data, np.uint8)
    grams = width - GRAM + 1
    for base in range(0, len(data) - width + 1, CHUNK):
        h = _gram_hashes(whole[base:base + CHUNK + width - 1])
        low = (h & ~_U((1 << _LOW) - 1)) | np.arange(len(h), dtype=_U)
        span = 1
        while span * 2 <= grams:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:len(low) - (grams - span)], low[grams - span:]) if grams > span else low
        at = (low & _U((1 << _LOW) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        yield base + first, last - first + width, h[at[first]].view(np.int64)


def split_stretch(data: bytes, h: int, left: int, right: int, width: int = WIDTH):
    """(start, bytes, left, right, hash) of one or two parts of a stretch whose windows all hold
    bytes left to right (left < 0: the gram of hash ``h``), each with more bytes in common: the windows that
    have room for them on the right, and the others, which have it on the left."""
    if left < 0:
        low, high = len(data) - width, width - GRAM  # where all windows can hold the gram
        found = np.flatnonzero(_gram_hashes(np.frombuffer(data, np.uint8))[low:high + 1].view(np.int64) == h)
        left = low + int(found[0])
        right = left + GRAM
    more = (width + 1 - (right - left)) // 2
    cut = min(max(0, right + more - width), len(data) - width + 1)  # the first window that has room on the right
    if cut < len(data) - width + 1:
        name = xxhash.xxh3_64_intdigest(data[left:right + more], 1 + right - left)
        yield cut, data[cut:], left - cut, right + more - cut, name
    if cut:
        name = xxhash.xxh3_64_intdigest(data[left - more:right], 1001 + right - left)
        yield 0, data[:cut + width - 1], left - more, right, name


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, in order; bytes after the end count as zeros."""
    key = np.concatenate((data, np.zeros(8, np.uint8))).astype(_U)
    for k in (1, 2, 4):
        key = (key[:-k] << _U(8 * k)) | key[k:]
    return key[:len(data)]


def sort_buckets(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bucket pointer of every suffix of ``data``: pointers are in the order of the suffixes,
    and suffixes of equal pointers agree on ``width`` bytes. Of suffixes that agree, some
    may be told apart by bytes further on; they stand next to each other.

    Positions after the end are one last suffix."""
    n = len(data)
    key = _words(data)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, n))
    pointers, depth = np.full(n + width, n, np.int64), np.full(n + width, width, np.int64)
    pointers[order] = np.repeat(start, size)
    several = np.repeat(size > 1, size)
    todo = order[several]
    depth[todo] = min(8, width)

    def refine(active: np.ndarray) -> np.ndarray:
        """Sort each bucket by the pointers as far on as it agrees; what has to go on."""
        ahead = depth[active]
        key = (pointers[active].astype(_U) << _U(32)) | pointers[active + ahead].astype(_U)
        order = np.argsort(key)
        key, at = key[order], active[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(at)))
        old = (key[start] >> _U(32)).astype(np.int64)  # of each new bucket, the place of the bucket it comes from
        head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        offset = start - np.repeat(start[head], np.diff(np.append(head, len(start))))
        one = at[start]
        known = np.where(size > 1, np.minimum(width, depth[one] + depth[one + depth[one]]), width)
        pointers[at] = np.repeat(old + offset, size)
        depth[at] = np.repeat(known, size)
        return at[np.repeat(known < width, size)]

    while len(todo):
        cuts = np.linspace(0, len(todo), PARTS + 1).astype(int)[1:-1] if len(todo) > 1024 else np.zeros(0, int)
        if len(cuts):  # between buckets
            p = pointers[todo]
            cuts = np.unique(np.searchsorted(p, p[cuts]))
        todo = np.concatenate([refine(part) for part in np.split(todo, cuts) if len(part)])
    return pointers[:n]


def repeated(parts: list[bytes], weights, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """Ranges of each part that windows cover whose bytes start a window elsewhere in
    the parts; a part of weight two or more stands for as many occurrences."""
    lengths = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(lengths)
    pointers = sort_buckets(data, width)
    counts = lengths - width + 1
    part = np.repeat(np.arange(len(parts)), counts)
    start = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = start + (ends - lengths)[part]
    order = np.argsort(pointers[place], kind="stable")
    # neighbours that further bytes tell apart are compared byte by byte, eight at once
    at = place[order]
    same = pointers[at[1:]] == pointers[at[:-1]]
    open_ = np.flatnonzero(~same)
    words = _words(data)
    for k in (*range(0, width - 7, 8), max(0, width - 8)):
        open_ = open_[words[at[open_] + k] == words[at[open_ + 1] + k]]
    same[open_] = True
    group = np.concatenate(([0], np.cumsum(~same))) if len(at) else np.zeros(0, int)
    hit = np.zeros(len(part), bool)
    hit[order] = np.bincount(group, weights=np.asarray(weights, float)[part][order])[group] >= 2 if len(at) else False
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    part, start = part[hit], start[hit]
    if len(part):
        new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (start[1:] > start[:-1] + width))))
        for i, a, b in zip(part[new], start[new], start[np.concatenate((new[1:], [len(part)])) - 1]):
            out[i].append((int(a), int(b) + width))
    return out


def merge(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGES = "array<struct<a:int,b:int>>"


def _judge(batches):
    """Stretches of a shard, sorted by gram, in; the ranges that repeat out. Grams
    stay together, as many at once as SORT_BYTES hold."""
    held: list = []
    done: list = []
    size = 0

    def sort() -> None:
        done.extend((r[0], r[1], [{"a": a, "b": b} for a, b in s]) for r, s in zip(held, repeated([r[3] for r in held], [r[2] for r in held])) if s)

    for batch in batches:
        for row in zip(batch.h, batch.c, batch.n, batch.bytes):
            if held and row[0] != held[-1][0] and size >= SORT_BYTES:
                sort()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
        if len(done) >= 4096:
            yield pd.DataFrame(done, columns=["h", "c", "ranges"])
            done = []
    if held:
        sort()
    yield pd.DataFrame(done, columns=["h", "c", "ranges"])


def repeated_ranges(docs: DataFrame, id_col="doc_id", text_col="text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, packed text) and the ranges of bytes to remove of those
    that have any (doc_id, key, ranges; neither sorted nor merged)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("key", F.xxhash64("text"))

    def find(with_place: bool):
        def run(batches):
            for b in batches:
                out: list = []
                for i, key, text in zip(b.doc_id, b.key, b.text):
                    data = text.encode("utf-8", "surrogatepass")
                    for start, length, h in stretches(data):
                        c = np.array([xxhash.xxh3_64_intdigest(data[x:x + n]) for x, n in zip(start.tolist(), length.tolist())], _U).view(np.int64) if with_place else None
                        out.append((i, key, start, length, h, c))
                if not out:
                    continue
                h = np.concatenate([o[4] for o in out])
                if not with_place:
                    yield pd.DataFrame({"h": h})
                    continue
                n = [len(o[4]) for o in out]
                yield pd.DataFrame({"doc_id": pd.Series([o[0] for o in out]).repeat(n).to_numpy(), "key": np.repeat([o[1] for o in out], n), "pos": np.concatenate([o[2] for o in out]).astype(np.int32),
                                    "len": np.concatenate([o[3] for o in out]).astype(np.int32), "h": h, "c": np.concatenate([o[5] for o in out])})
        return run

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "key": b.key, "packed": [z.compress(t.encode("utf-8", "surrogatepass")) for t in b.text]})

    packed = d.mapInPandas(pack, f"doc_id {kind}, key long, packed binary")
    grams = d.mapInPandas(find(False), "h long").groupBy("h").count().where("count > 1").select("h")
    places = d.mapInPandas(find(True), f"doc_id {kind}, key long, pos int, len int, h long, c long")
    places = materialise(places.join(materialise(grams), "h"))  # two plain exchanges: a hot gram's partition can be split
    # equal stretches are sorted once, with their number
    kinds = places.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "pos", "len")).alias("at"))
    wanted = kinds.select("h", "c", "n", "at.*").groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "c", "n", "pos", "len")).alias("want"))
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "key": "w_key"})

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for data, want in zip(b.packed, b.want):
                data = z.decompress(data)
                rows += [(w["h"], w["c"], w["n"], data[w["pos"]:w["pos"] + w["len"]]) for w in want]
            yield pd.DataFrame(rows, columns=["h", "c", "n", "bytes"])

    first = packed.join(wanted, packed.doc_id.eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("packed", "want")
    texts = materialise(first.mapInPandas(cut, "h long, c long, n long, bytes binary").dropDuplicates(["h", "c"]))
    judged = judge(texts.withColumns({"left": F.lit(-1), "right": F.lit(-1)}), hot)
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("pos")).alias("a"), (r["b"] + F.col("pos")).alias("b")))
    back = places.join(judged, ["h", "c"]).select("doc_id", "key", shifted.alias("ranges"))
    # rows alike in id and text bring the same ranges: a set, not a list
    return packed, back.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def judge(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(h, c, ranges) of the stretches ``texts`` (h, c, n, bytes, left, right) that repeat something.

    Grams of more than ``hot`` different stretches are refined: each stretch is parted by the bytes
    that its windows have in common, parts that are equal become one, and so on with
    those that are still many, until windows are whole (nine times at most)."""
    many = materialise(texts.groupBy("h").count().where(F.col("count") > hot).select("h"))
    n = many.count()

    def sort(rows):
        dealt = rows.select("h", "c", "n", "bytes").repartition("h").sortWithinPartitions("h", "c")
        return dealt.mapInPandas(_judge, f"h long, c long, ranges {_RANGES}")

    if not n:
        return sort(texts)
    few = maybe_broadcast(many, n, 16)

    def split(batches):
        for b in batches:
            out = []
            for h, c, n, data, left, right in zip(b.h, b.c, b.n, b.bytes, b.left, b.right):
                for start, part, x, y, name in split_stretch(data, h, left, right):
                    digest = xxhash.xxh3_64_intdigest(part)
                    out.append((*np.array([name, digest], _U).view(np.int64).tolist(), n, part, x, y, h, c, start))
            yield pd.DataFrame(out, columns=["h", "c", "n", "bytes", "left", "right", "from_h", "from_c", "start"])

    parts = texts.join(few, "h", "left_semi").mapInPandas(
        split, "h long, c long, n long, bytes binary, left int, right int, from_h long, from_c long, start int")
    parts = materialise(parts)
    again = parts.groupBy("h").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("h")  # alone, a part repeats nothing
    alike = parts.join(materialise(again), "h").groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("bytes", "left", "right")).alias("one"))
    found = judge(materialise(alike.select("h", "c", "n", "one.*")), hot)
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    found = found.join(parts.select("h", "c", "from_h", "from_c", "start"), ["h", "c"])
    found = found.select(F.col("from_h").alias("h"), F.col("from_c").alias("c"), moved.alias("ranges"))
    return sort(texts.join(few, "h", "left_anti")).union(found)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, spans (maximal removed runs of bytes), kept (the
    remaining bytes) and n_bytes.

    A byte goes when a window of 200 bytes over it also starts anywhere else, in the
    same document or another; windows never cross documents. A null text is empty.
    Texts under 200 bytes stay whole; equal rows are copies of each other and lose
    all they have. An empty table gives no rows; other columns are ignored."""
    packed, ranges = repeated_ranges(docs, id_col, text_col, hot)
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = ranges.select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "ranges")
    joined = packed.join(ranges, packed.doc_id.eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left").select("doc_id", "packed", "ranges")

    def keep(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for i, data, found in zip(b.doc_id, b.packed, b.ranges):
                data = z.decompress(data)
                spans = merge((r["a"], r["b"]) for r in found) if found is not None else []
                edges = [0, *(x for s in spans for x in s), len(data)]
                rows.append((i, len(data), [{"a": a, "b": b} for a, b in spans], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInPandas(keep, f"doc_id {kind}, n_bytes long, spans {_RANGES}, kept binary")


def op10_substring_dedup(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by grouping all windows, written in hexadecimal digits.
ORACLE = """
with d as (select doc_id, row_number() over () as rn, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rn, s, md5(substr(h, 2 * s + 1, 400)) as m from (select rn, h, unnest(range(0, len(h) // 2 - 199)) as s from d)),
r as (select rn, s from w where m in (select m from w group by m having count(*) > 1)),
g as (select rn, s, case when s <= lag(s) over (partition by rn order by s) + 200 then 0 else 1 end as fresh from r),
i as (select rn, s, sum(fresh) over (partition by rn order by s) as run from g),
p as (select rn, run, min(s) as a, max(s) + 200 as b from i group by rn, run),
e as (select rn, a, b, coalesce(lag(b) over (partition by rn order by a), 0) as before from p),
k as (select e.rn, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from e join d using (rn) group by e.rn)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (rn)
"""


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, digest of what is kept) of each text, for tests."""
    datas = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for data in datas:
        for k in range(len(data) - width + 1):
            w = data[k:k + width]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for data in datas:
        spans = merge((k, k + width) for k in range(len(data) - width + 1) if seen[data[k:k + width]] > 1)
        edges = [0, *(x for s in spans for x in s), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
