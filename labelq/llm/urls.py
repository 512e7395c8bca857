"""URL filter over sorted arrays of 64-bit digests (operator 8).

The rules' keys (host and path) are hashed with XXH64 and sorted. Workers map
the array into memory and probe it with a vectorised binary search; a hit
counts only when the stored full string equals the probed one. A rule list
above the broadcast bound is cut into one array for each range of digests; the
keys to be probed are dealt out by the same ranges.
"""

from __future__ import annotations

import hashlib
import math
import mmap
import os

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import BROADCAST_BYTES, materialise, maybe_broadcast, table

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


def digest(key: str) -> int:
    """What xxhash64() gives, unsigned."""
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)


class DigestArray:
    """Sorted uint64 digests, the verdict of each and the full strings behind them.

    Bytes: count, blob length, digests, string offsets, verdicts, strings."""

    @staticmethod
    def pack(rules: list[tuple[str, bool]]) -> bytes:
        """rules: (host + path, blocked). A key listed twice is blocked if any of its rules blocks."""
        found: dict[str, bool] = {}
        for key, blocked in rules:
            found[key] = found.get(key, False) or blocked
        rows = sorted((digest(k), k.encode("utf-8", "surrogatepass"), b) for k, b in found.items())
        blob = b"".join(r[1] for r in rows)
        head = np.array([len(rows), len(blob)], "<u8").tobytes()
        keys = np.array([r[0] for r in rows], "<u8").tobytes()
        ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8").tobytes()
        return head + keys + ends + np.array([r[2] for r in rows], "u1").tobytes() + blob

    def __init__(self, data):
        """data: what pack() made, as a memory map or any other buffer."""
        raw = np.frombuffer(data, "u1")
        n, size = (int(x) for x in raw[:16].view("<u8"))
        self.keys = raw[16:16 + 8 * n].view("<u8")
        at = 16 + 8 * n
        self.ends = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.blocked, self.blob = raw[at:at + n], raw[at + n:at + n + size]
        #: Lengths that the paths of rules have: the only prefixes worth probing.
        texts = (self.text(i) for i in range(n))
        self.path_lengths = sorted({len(t) - (t.find("/") if "/" in t else len(t)) for t in texts})

    def text(self, i: int) -> str:
        return self.blob[int(self.ends[i]):int(self.ends[i + 1])].tobytes().decode("utf-8", "surrogatepass")

    def find(self, probes: list[str]) -> np.ndarray:
        """Index of each probe, or -1."""
        want = np.array([digest(p) for p in probes], "<u8")
        at = np.searchsorted(self.keys, want)
        out = np.full(len(probes), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want) if len(self.keys) else []):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:  # digests may collide
                if self.text(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out


_OPEN: dict[str, DigestArray] = {}


def _mapped(data: bytes) -> DigestArray:
    """The array in an anonymous file, mapped read-only, once a worker; no folder is written to."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _OPEN:
        if hasattr(os, "memfd_create"):
            fd = os.memfd_create("digests")
            with open(fd, "wb") as f:
                f.write(data)
                f.flush()
                data = mmap.mmap(fd, len(data), access=mmap.ACCESS_READ)
        _OPEN[name] = DigestArray(data)
    return _OPEN[name]


def candidates(host: str, path: str, path_lengths) -> list[str]:
    """Keys of all rules that could fit: every host suffix with every listed path length."""
    if not host:
        return []
    labels = host.split(".")
    return [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in path_lengths if n <= len(path)]


def judge_urls(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the longest fitting rule or null, and its verdict.

    rules: list of (``host/path``, ``block`` or ``allow``), or a DataFrame with
    columns rule and verdict. A rule fits its host and all subdomains when the
    page's path starts with the rule's. A rule listed twice blocks if it does so once. A null URL or one without ``://`` has
    empty host and path and gets ``default``. Repeated pages each get a row;
    no pages give no rows; other columns are ignored."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if not isinstance(rules, DataFrame) and sum(len(r) + 32 for r, _ in rules) > BROADCAST_BYTES:
        rules = pages.sparkSession.createDataFrame(rules, "rule string, verdict string")
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.length("rule") + 32), F.lit(0))).first()[0]
        if size > BROADCAST_BYTES:
            return _judge_in_ranges(rows, rules, default, size)
        rules = [(r.rule, r.verdict) for r in rules.select("rule", "verdict").collect()]
    data = pages.sparkSession.sparkContext.broadcast(DigestArray.pack([(r, v == "block") for r, v in rules]))

    def judge(batches):
        index = _mapped(data.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.url]
            probes, owner = [], []
            for i, (host, path) in enumerate(parts):
                c = candidates(host, path, index.path_lengths)
                probes += c
                owner += [i] * len(c)
            best: dict[int, tuple[int, int]] = {}
            found = index.find(probes)
            for j in np.flatnonzero(found >= 0):
                best[owner[j]] = max(best.get(owner[j], (-1, -1)), (len(probes[j]), int(found[j])))
            rule = [index.text(best[i][1]) if i in best else None for i in range(len(parts))]
            verdict = [("block" if index.blocked[best[i][1]] else "allow") if i in best else default for i in range(len(parts))]
            yield pd.DataFrame({"page_id": batch.page_id, "host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": rule, "verdict": verdict})

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_in_ranges(rows: DataFrame, rules: DataFrame, default: str, size: int) -> DataFrame:
    """The way for rule lists of any size: an array for each range of digests. Each distinct
    key of all URLs is probed once, so that a hot host is no hot range."""
    bits = max(1, math.ceil(math.log2(size / BROADCAST_BYTES)) + 1)
    range_of = F.shiftrightunsigned(F.xxhash64("rule"), 64 - bits).alias("range")
    rules = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict")).where("rule is not null")
    path = F.when(F.instr("rule", "/") > 0, F.length("rule") - F.instr("rule", "/") + 1).otherwise(0)
    lengths = sorted(r[0] for r in rules.select(path).distinct().collect())  # at most the longest rule's length

    def pack(pdf):
        data = DigestArray.pack([(r, v == "block") for r, v in zip(pdf.rule, pdf.verdict)])
        return pd.DataFrame({"range": pdf.range[:1], "data": [data]})

    arrays = rules.select("rule", "verdict", range_of).groupBy("range").applyInPandas(pack, "range long, data binary")

    def probe(batches):
        for batch in batches:
            out = [(u, *split_url(u), candidates(*split_url(u), lengths)) for u in batch.url]
            yield pd.DataFrame(out, columns=["url", "host", "path", "keys"])

    urls = rows.select("url").distinct().mapInPandas(probe, "url string, host string, path string, keys array<string>")
    asked = urls.select(F.explode("keys").alias("rule")).distinct().select("rule", range_of)

    def search(batches):
        """An array comes before the keys of its range."""
        at, index = None, None
        for b in batches:
            out = []
            for k, part in b.groupby("range", sort=False):
                for data in part.data[part.rule.isna()]:
                    at, index = k, DigestArray(data)
                if at != k:  # a range without a rule
                    continue
                probes = list(part.rule[part.rule.notna()])
                out += [(p, bool(index.blocked[f])) for p, f in zip(probes, index.find(probes)) if f >= 0]
            yield pd.DataFrame(out, columns=["rule", "blocked"])

    none = lambda kind: F.lit(None).cast(kind)
    both = arrays.select("range", none("string").alias("rule"), "data").union(asked.select("range", "rule", none("binary")))
    dealt = both.repartition(1 << bits, "range").sortWithinPartitions("range", F.col("rule").asc_nulls_first())
    known = materialise(dealt.mapInPandas(search, "rule string, blocked boolean"))
    fits = urls.select("url", F.explode("keys").alias("rule")).join(maybe_broadcast(known, known.count(), 256), "rule")
    best = fits.groupBy(F.col("url").alias("best_url")).agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "blocked")).alias("best"))
    verdict = F.when(F.col("best.blocked"), "block").when(F.col("best").isNotNull(), "allow").otherwise(default)
    judged = urls.drop("keys").join(best, F.col("url").eqNullSafe(F.col("best_url")), "left").select(
        F.col("url").alias("judged_url"), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
    return rows.join(judged, F.col("url").eqNullSafe(F.col("judged_url"))).select("page_id", "host", "path", "rule", "verdict")


#: The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op8_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
with u as (select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from u)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r
"""
