"""Benchmark decontamination by template canonicalisation (operator 2).

Numbers, names and units become typed placeholders, so that a question with other
parameters keeps its template: a run of name words is one name, a number with its unit
or currency sign, in digits or words, is one quantity. Windows of template words of
documents and of benchmark items meet in a hash join; along each alignment the slots must be
filled consistently: one value of the item always stands for the same value of
the document, and windows that break with it are dropped. Windows of the words themselves
meet too, at every position: a verbatim passage counts however few literal words it has
and whatever other slots hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import BROADCAST_BYTES, maybe_broadcast, materialise, small_batches, table, text_key

#: Words of a window, those of them that must not be placeholders, the share of an
#: item's windows that marks a document, and the run of words that does so alone.
WINDOW, LITERALS, LEAST, RUN = 5, 3, 0.8, 13
#: Units that a number may carry, and signs that are units by themselves.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonnes lb lbs oz pound pounds ounce ounces "
         "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "mph kph km/h cent cents dollar dollars euro euros usd eur gbp percent degree degrees hz khz mhz ghz w kw kwh v j kj cal kcal pa kpa bar byte bytes kb mb gb tb").split()
SIGNS = "%$€£¥°"
#: Number words and their digits; currency words and their signs.
NUMBERS = dict(zip(("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
                    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split(),
                   (*map(str, range(21)), "30", "40", "50", "60", "70", "80", "90", "100", "1000", "1000000", "1000000000")))
CURRENCY = {"dollar": "$", "dollars": "$", "usd": "$", "euro": "€", "euros": "€", "eur": "€", "gbp": "£", "percent": "%"}
_ENDS = ".!?:;\n\"“”«»()[]"
_U = np.uint64
#: Stand for a number, a unit, a number with a unit, and a name.
_TYPES = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9, 0xD1B54A32D192ED03], _U)
_VERBATIM = _U(0x8CB92BA72F3D8DD7)
_tables: dict | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def _powers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def _kinds() -> dict:
    """Per code point: 1 letter, 2 digit, 3 sign; upper case; sentence end. Per process."""
    global _tables
    if _tables is None:
        n = 0x110000
        kind = np.zeros(n, np.uint8)
        kind[np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)] = 1
        kind[ord("0"):ord("9") + 1] = 2
        kind[[ord(c) for c in SIGNS]] = 3
        end = np.zeros(n, bool)
        end[[ord(c) for c in _ENDS]] = True
        _tables = {"kind": kind, "upper": np.fromiter((chr(c).isupper() for c in range(n)), bool, n), "end": end, "pow": _powers(64, 1), "win": _powers(64, 2)}
        word = lambda x: _tokens(x)["hash"][0]
        _tables["units"] = np.sort([word(u) for u in UNITS if u.isalpha()])
        _tables["numbers"] = np.sort([word(x) for x in NUMBERS])
        same = sorted((word(x), word(y)) for x, y in [*NUMBERS.items(), *CURRENCY.items()])
        _tables["from"], _tables["to"] = (np.array(x, _U) for x in zip(*same))
    return _tables


def _tokens(text: str) -> dict:
    """Words of a text: hash, kind, whether capitalised, whether first of a sentence, whether
    the second letter is a capital too."""
    t = _tables
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = t["kind"][code].copy()
    if len(code) > 2:  # a point or comma between digits belongs to the number
        mid = (code[1:-1] == 46) | (code[1:-1] == 44)
        kind[1:-1][mid & (kind[:-2] == 2) & (kind[2:] == 2)] = 2
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    start = np.flatnonzero(first)
    if not len(start):
        return {"hash": np.zeros(0, _U), "kind": np.zeros(0, np.uint8), "capital": np.zeros(0, bool), "initial": np.zeros(0, bool), "loud": np.zeros(0, bool)}
    lower = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.flatnonzero(kind > 0)
    word = np.cumsum(first)[inside] - 1
    place = inside - start[word]
    value = (lower[inside].astype(_U) + _U(1)) * t["pow"][place & 63] + (place >> 6).astype(_U) * _U(0x2545F4914F6CDD1D)
    begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    hashes = _mix(np.add.reduceat(value, begins))
    ends = np.cumsum(t["end"][code])
    at = ends[start]
    initial = np.concatenate(([True], at[1:] > at[:-1]))
    follow = np.minimum(start + 1, len(code) - 1)
    capital = t["upper"][code[start]] & (kind[follow] == 1) & ~t["upper"][code[follow]] & (follow > start)
    loud = t["upper"][code[follow]] & (kind[follow] == 1) & (kind[start] == 1) & (follow > start)
    return {"hash": hashes, "kind": kind[start], "capital": capital, "initial": initial, "loud": loud}


def template(text: str | None) -> dict:
    """Words of a whole text and its two templates.

    ``exact``: hash of each word but for the case of its first letter; ``lit``: the number of
    words before it that are literal in any template, a coordinate that slots of several
    words leave as it is. ``plain`` and ``named``: template words (a capitalised first word of a
    sentence is itself in the one, a name in the other), each with its hash, the value in
    its slot, whether it is a slot, whether the other template differs there, and its first word."""
    _kinds()
    w = _tokens(text or "")
    h, kind = w["hash"], w["kind"]
    if not len(h):
        none = {k: np.zeros(0, t) for k, t in (("hash", _U), ("value", _U), ("slot", bool), ("maybe", bool), ("first", int))}
        return {"exact": h, "lit": np.zeros(0, int), "plain": none, "named": none}
    number = (kind == 2) | np.isin(h, _tables["numbers"])
    after = np.concatenate(([False], number[:-1]))
    unit = (kind == 3) | ((kind == 1) & after & np.isin(h, _tables["units"]))
    cased = w["capital"] & ~unit & ~number
    at = np.minimum(np.searchsorted(_tables["from"], h), len(_tables["from"]) - 1)
    value = np.where(_tables["from"][at] == h, _tables["to"][at], h)
    literal = ~(cased | unit | number)
    out = {"exact": h + w["loud"] * _VERBATIM, "lit": np.cumsum(literal) - literal}
    for variant, name in (("plain", cased & ~w["initial"]), ("named", cased)):
        group = np.where(number | unit, 1, np.where(name, 2, 0))
        new = np.concatenate(([True], (group[1:] == 0) | (group[1:] != group[:-1]) | w["initial"][1:]))
        first = np.flatnonzero(new)
        flags = np.bitwise_or.reduceat(number * 1 | unit * 2 | name * 4, first)
        slot = flags > 0
        own = np.add.reduceat(value, first)
        out[variant] = {"hash": np.where(slot, _TYPES[flags], h[first]), "value": own, "slot": slot,
                        "maybe": np.logical_or.reduceat(cased & w["initial"], first), "first": first}
    return out


def windows(t: dict, size: int):
    """(variant, place in the template, window hash) of all windows of the templates with enough
    literal words; the second variant only where it differs."""
    pw = _tables["win"][:size]
    for variant in ("plain", "named"):
        v = t[variant]
        n = len(v["hash"]) - size + 1
        if n <= 0:
            continue
        total = np.zeros(n, _U)
        lit = np.zeros(n, np.int16)
        differs = np.zeros(n, bool)
        for k in range(size):
            total += v["hash"][k:k + n] * pw[k]
            lit += ~v["slot"][k:k + n]
            differs |= v["maybe"][k:k + n]
        ok = lit >= min(size, LITERALS)
        if variant == "named":
            ok &= differs
        at = np.flatnonzero(ok)
        yield variant, at, _mix(total[at] + _U(size))


def verbatim(t: dict, size: int) -> np.ndarray:
    """Hash of the words themselves, but for the case of their first letters, of the window
    at every position."""
    n = len(t["exact"]) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(size):
        total += t["exact"][k:k + n] * _tables["win"][k]
    return _mix(total ^ _VERBATIM) + _U(size)


_COLUMNS = ["id", "key", "pos", "lit", "h", "slots", "exact"]


def _rows_of(ids, keys, texts, sizes, keep=None) -> pd.DataFrame:
    out = []
    for i, key, text in zip(ids, keys, texts):
        t = template(text)
        lit = t["lit"]
        for size in sizes:
            for variant, at, h in windows(t, size):
                v = t[variant]
                if keep is not None and len(at):
                    hit = keep(h)
                    at, h = at[hit], h[hit]
                for a, x in zip(at.tolist(), h.view(np.int64).tolist()):
                    filled = v["value"][a:a + size][v["slot"][a:a + size]]
                    p = int(v["first"][a])
                    out.append((i, key, p, int(lit[p]), x, filled.view(np.int64).tolist(), False))
            h = verbatim(t, size)
            at = np.arange(len(h)) if keep is None else np.flatnonzero(keep(h))
            out += [(i, key, p, int(lit[p]), x, [], True) for p, x in zip(at.tolist(), h[at].view(np.int64).tolist())]
    return pd.DataFrame(out, columns=_COLUMNS)


def judge_alignment(found, size: int, run: int) -> tuple[dict, bool, int]:
    """Of the windows of one alignment: the positions that stand (and whether they have a
    template), whether they hold a run of ``run`` words, and the slots filled otherwise than the item's.

    Each value of the item takes the document's value that most windows give it, its own
    before others; windows that give another one are dropped unless they are verbatim."""
    votes: dict = {}
    for x in found:
        for f in x["fill"]:
            own = votes.setdefault(f["item"], {})
            own[f["doc"]] = own.get(f["doc"], 0) + 1
    chosen = {item: max(docs, key=lambda d: (docs[d], d == item, d)) for item, docs in votes.items()}
    stand = {int(x["pos"]): bool(x["typed"]) for x in found if x["exact"] or all(chosen[f["item"]] == f["doc"] for f in x["fill"])}
    length, last, long = 0, None, False
    for p in sorted(stand):
        length = length + 1 if last is not None and p == last + 1 else 1
        last = p
        long |= run > size and length >= run - size + 1
    return stand, long, sum(d != i for i, d in chosen.items())


def _membership(digests: np.ndarray):
    """Test of window hashes against the sorted digests, behind a table of their leading bits."""
    table_ = np.zeros(1 << 22, bool)
    table_[digests >> _U(42)] = True

    def keep(h):
        hit = table_[h >> _U(42)]
        at = np.flatnonzero(hit)
        if len(at):
            k = np.minimum(np.searchsorted(digests, h[at]), len(digests) - 1)
            hit[at] = digests[k] == h[at]
        return hit

    return keep


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                      least: float = LEAST, run: int = RUN) -> DataFrame:
    """One row per document and benchmark item that the document holds: doc_id, key (the digest
    of its text), item_id, windows (item windows found), coverage (their share) and changed
    (slots filled with another value than the item's).

    A document holds an item when it has ``least`` of the item's windows of five
    template words, or of all its windows of five words, or a run of ``run`` words. A
    window is found by its template under consistent slots, or word for word, but for the
    case of first letters, whatever the other slots hold. Windows with fewer than three literal
    words (or fewer than all, where shorter) have no template and are found word for word only.
    Items shorter than a window count whole. Coverage is the greater of the two shares. Null and
    empty texts hold nothing and are held nowhere. Documents are told apart by id and text: rows
    alike in both are one, rows without an id are judged by their texts; equal items
    are each reported. Empty tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))

    def item_rows(batches):
        for b in batches:
            parts = [pd.DataFrame(columns=[*_COLUMNS, "size", "total", "places", "typed"])]
            for i, text in zip(b.id, b.text):
                size = min(len(template(text)["exact"]), WINDOW)
                if size:
                    rows = _rows_of([i], [0], [text], [size])
                    typed = rows.pos[~rows.exact.astype(bool)].unique()
                    parts.append(rows.assign(size=size, total=len(typed), places=rows.pos.nunique(), typed=rows.pos.isin(typed)))
            kinds = {"size": int, "total": int, "places": int, "pos": int, "lit": int, "key": int, "exact": bool, "typed": bool}
            yield pd.concat(parts).astype(kinds)

    window = "key long, pos int, lit int, h long, slots array<long>, exact boolean"
    bench = materialise(items.mapInPandas(item_rows, f"id {item_kind}, {window}, size int, total int, places int, typed boolean"))
    sizes = sorted({WINDOW, *(r[0] for r in bench.select("size").distinct().collect())})
    n_digests = bench.select("h").distinct().count()
    digests = None
    if n_digests * 8 <= BROADCAST_BYTES:
        known = bench.select("h").distinct().toPandas().h.to_numpy(np.int64).view(_U)
        digests = spark.sparkContext.broadcast(np.sort(known))

    def doc_rows(batches):
        keep = None if digests is None else _membership(digests.value) if len(digests.value) else (lambda h: np.zeros(len(h), bool))
        for b in batches:
            yield _rows_of(b.id, b.key, b.text, sizes, keep)

    d = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    d = d.mapInPandas(doc_rows, f"id {kind}, {window}").drop("exact", "pos")
    i = bench.select("h", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("lit").alias("item_lit"),
                     F.col("slots").alias("item_slots"), "exact", "total", "places", "typed", "size")
    met = d.join(maybe_broadcast(i, bench.count(), 256), "h").withColumn("shift", F.col("lit") - F.col("item_lit"))
    # along one alignment: at most the item's windows, so this set is bounded by its length
    fill = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    found = F.collect_set(F.struct(F.col("item_pos").alias("pos"), "exact", "typed", fill.alias("fill")))
    lines = met.groupBy("id", "key", "item_id", "shift", "total", "places", "size").agg(found.alias("found"))

    def align(batches):
        for b in batches:
            out = []
            for i, key, item, total, places, size, w in zip(b.id, b.key, b.item_id, b.total, b.places, b["size"], b.found):
                stand, long, changed = judge_alignment(w, int(size), run)
                out += [(i, key, item, total, places, p, typed, long, changed) for p, typed in stand.items()]
            yield pd.DataFrame(out, columns=["id", "key", "item_id", "total", "places", "p", "typed", "long", "changed"])

    each = lines.mapInPandas(align, f"id {kind}, key long, item_id {item_kind}, total int, places int, p int, typed boolean, long boolean, changed int")
    whole = each.groupBy("id", "key", "item_id", "total", "places").agg(
        F.count_distinct("p").alias("windows"), F.count_distinct(F.when(F.col("typed"), F.col("p"))).alias("own"),
        F.max("long").alias("long"), F.min("changed").alias("changed"))
    share = F.greatest(F.when(F.col("total") > 0, F.col("own") / F.col("total")), F.col("windows") / F.col("places"))  # a null counts for nothing
    whole = whole.withColumn("coverage", share).where((F.col("coverage") >= least) | F.col("long"))
    return whole.select(F.col("id").alias("doc_id"), "key", "item_id", "windows", "coverage", "changed")


def op2_decontamination(spark, sf_dir):
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
