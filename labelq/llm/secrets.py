"""Secret scan through a trigram inverted index (operator 4).

DataFrame functions only. Each rule's regex is turned, on the driver, into a
Boolean query over trigrams that every match must contain. Postings of those
trigrams (lists of documents, in blocks of bounded size) are intersected and
united, and only the candidates are verified with the regex itself. A rule with
no mandatory trigram scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import materialise, table

#: Documents whose postings stand in one block on average.
BLOCK_DOCS = 2048
ANY = ("any",)


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str          #: understood alike by Java's and Python's engines
    group: int = 0
    least: int = 0      #: characters of that group; shorter matches are dropped


#: The base rules, in the order of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is too short holds no match at a later start either, so the bound may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Spans that the method adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


def _flat(op: str, parts) -> list:
    return list(dict.fromkeys(x for p in parts for x in (p[1:] if p[0] == op else (p,))))


def _all(parts) -> tuple:
    parts = [p for p in _flat("and", parts) if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts) -> tuple:
    """Alternatives that ask for more than another one asks for add nothing and go."""
    parts = _flat("or", parts)
    if ANY in parts or not parts:
        return ANY
    needs = {p: frozenset(p[1:] if p[0] == "and" else (p,)) for p in parts}
    parts = [p for p in parts if not any(needs[q] < needs[p] for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings) -> tuple:
    """Documents with one of the strings have these trigrams."""
    return _either(_all(("has", s[i:i + 3]) for i in range(len(s) - 2)) for s in sorted(strings))


def trigram_query(regex: str, most: int = 64) -> tuple:
    """A query that holds for the lower-cased text of everything that matches:
    ('any',), ('has', trigram), ('and', ...) or ('or', ...).

    Parts with at most ``most`` possible strings are multiplied out, so trigrams
    may span them; anything wider ends the current strings."""

    def strings(op, arg):
        """All strings of one node, or None."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and arg[0][0] is not C.NEGATE:
            out = set()
            for o, a in arg:
                if o is C.LITERAL:
                    out.add(chr(a).lower())
                elif o is C.RANGE and a[1] - a[0] < most:
                    out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is C.SUBPATTERN:
            return exact(arg[3])
        if op is C.BRANCH:
            parts = [exact(b) for b in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 3 and (one := exact(arg[2])) is not None:
            out = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            return out if len(out) <= most else None
        return {""} if op is C.AT else None

    def exact(nodes):
        out = {""}
        for op, arg in nodes:
            if (s := strings(op, arg)) is None:
                return None
            out = {a + b for a in out for b in s}
            if len(out) > most:
                return None
        return out

    def query(nodes):
        parts, run = [], {""}
        for op, arg in nodes:
            s = strings(op, arg)
            if s is not None and len(run) * len(s) <= most:
                run = {a + b for a in run for b in s}
                continue
            parts.append(_of_strings(run))
            run = s if s is not None else {""}
            if s is None:
                if op is C.SUBPATTERN:
                    parts.append(query(arg[3]))
                elif op is C.BRANCH:
                    parts.append(_either(query(b) for b in arg[1]))
                elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                    parts.append(query(arg[2]))
        return _all([*parts, _of_strings(run)])

    return query(P.parse(regex))


def trigrams(q: tuple) -> set[str]:
    return {q[1]} if q[0] == "has" else set().union(*map(trigrams, q[1:])) if len(q) > 1 else set()


def postings(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """The inverted index of ``docs`` (doc_id, text): a row for each block of documents, with a
    column for each trigram in ``wanted`` that lists the block's documents that contain it."""
    blocks = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-docs.count() // BLOCK_DOCS))))
    # a projection of its own, which all lists refer to: each text is lower-cased once
    low = docs.where("text is not null").select("doc_id", blocks.alias("block"), F.lower("text").alias("low"))
    return low.groupBy("block").agg(*(F.collect_set(F.when(F.contains(F.col("low"), F.lit(t)), F.col("doc_id"))).alias(_column(t)) for t in sorted(wanted)))


def _column(trigram: str) -> str:
    return "has_" + trigram.encode().hex()


def _evaluate(q: tuple) -> Column:
    if q[0] == "has":
        return F.col(_column(q[1]))
    return reduce(F.array_intersect if q[0] == "and" else F.array_union, (_evaluate(x) for x in q[1:]))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, end, kind) of one rule: the pieces between matches and the
    matches themselves give the positions, in code points."""
    pattern = F.lit(rule.regex)
    pieces, whole = F.split(text, rule.regex, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    spot = "struct<start:int,rank:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spot}>").alias("out"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + F.length(m["whole"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.length(m["kept"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    matches = F.zip_with(F.arrays_zip(whole.alias("whole"), kept.alias("kept")), F.slice(pieces, F.lit(1), F.size(whole)),
                         lambda m, gap: F.struct(F.length(gap).alias("gap"), m["whole"].alias("whole"), m["kept"].alias("kept")))
    return F.aggregate(matches, start, step, lambda acc: acc["out"])


def scan_secrets(docs: DataFrame, id_col="doc_id", text_col="text", base=BASE, added=ADDED) -> DataFrame:
    """One row per document: doc_id, text and ``found``, the spans (start, rank, end,
    kind; code points, end exclusive) ordered by start, then rule.

    A null text is empty and has no spans. Rows that repeat an id are each scanned
    (candidates are found by id, and the regex decides); rows without an id are
    scanned by every rule. An empty table gives no
    rows; other columns are ignored. Whole texts are scanned."""
    rules = [*base, *added]
    queries = [trigram_query(r.regex) for r in rules]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = set().union(*map(trigrams, queries))
    indexed = {r.kind: q for r, q in zip(rules, queries) if q != ANY}
    if indexed:
        found = postings(d, wanted).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), _evaluate(q).alias("docs")) for k, q in indexed.items()))).alias("r"))
        cand = found.select(F.col("r.kind").alias("kind"), F.explode("r.docs").alias("cand_id")).groupBy("cand_id").agg(F.collect_set("kind").alias("kinds"))
        d = d.join(materialise(cand), F.col("doc_id") == F.col("cand_id"), "left").drop("cand_id")
    else:
        d = d.withColumn("kinds", F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, r in enumerate(rules):
        due = F.col("text").rlike(r.regex)
        if r.kind in indexed:  # postings hold no null ids
            due = F.when(F.col("doc_id").isNull(), due).otherwise(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)))
        parts.append(F.when(due, _spans(F.col("text"), r, rank)).otherwise(empty))
    return d.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("found"))


def op4_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "found")
    write = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(write(base), 256).alias("base_sha256"), write(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The same spans in SQL, every rule scanned fully."""
    q = lambda s: s.replace("'", "''")
    rows = " union all ".join(
        f"select doc_id, rn, {k} as rank, '{r.kind}' as kind, regexp_extract_all(text, '{q(r.regex)}', 0) as w, "
        f"regexp_extract_all(text, '{q(r.regex)}', {r.group}) as g, string_split_regex(text, '{q(r.regex)}') as p, {r.least} as least from d"
        for k, r in enumerate([*BASE, *ADDED]))
    return f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rn from documents),
m as ({rows}),
e as (select *, unnest(range(1, len(w) + 1)) as i from m where len(w) > 0),
s as (select rn, rank, kind, w[i] as whole, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as b
    from e where length(g[i]) >= least),
t as (select *, kind || ':' || cast(cast(b as bigint) as varchar) || ':' || cast(cast(b + length(whole) as bigint) as varchar) as txt from s),
a as (select rn, count(*) filter (rank = 0) as na, count(*) filter (rank = 1) as nk, count(*) filter (rank = 2) as nh,
    string_agg(txt, ',' order by b, rank) filter (rank < {len(BASE)}) as base, string_agg(txt, ',' order by b, rank) as spans from t group by rn)
select doc_id, coalesce(na, 0) as n_assign, coalesce(nk, 0) as n_access, coalesce(nh, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (rn)"""


ORACLE = _oracle()

_FLAGS = re.ASCII


def brute_force(text: str | None, rules=(*BASE, *ADDED)) -> list[tuple[int, int, int, str]]:
    """Spans by Python's engine over the whole text, for tests."""
    out = []
    for rank, r in enumerate(rules):
        out += [(m.start(), rank, m.end(), r.kind) for m in re.finditer(r.regex, text or "", _FLAGS) if len(m.group(r.group)) >= r.least]
    return sorted(out)
