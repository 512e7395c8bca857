"""Quality classifier by co-training (operator 6).

Two views of a document, its text and its page metadata, have a classifier each.
In every round each labels the documents of a fresh pool that it is surest of,
for the other one to learn from; the pools are all documents without a label, dealt
to the rounds by a hash. Both are then calibrated on labelled rows that neither has
seen, and the calibrated views are combined to score all documents.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import discard, materialise, small_batches, table

BITS = 14
DIM = 1 << BITS
#: Shares and ratios of a text that stand beside its hashed character n-grams.
STATS = 12
META = 1 << 12
#: Bound of the labelled documents that training reads, of which a fifth calibrate; rounds, and
#: pseudo-labels that a view gives in one.
LABELLED, ROUNDS, GIVEN = 8000, 4, 200
_A, _B, _C, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
CHUNK = 1 << 20
#: Combined probability below which a document goes: the odds that it is bad are four to one.
CUT = 0.2
_classes: dict | None = None


def _class_tables() -> dict:
    global _classes
    if _classes is None:
        n = 0x110000
        of = lambda f: np.fromiter((f(chr(c)) for c in range(n)), bool, n)
        _classes = {"letter": of(str.isalpha), "upper": of(str.isupper), "digit": of(str.isdigit), "space": of(str.isspace)}
    return _classes


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text: hashed n-grams of one to three characters, damped and of
    unit length, and STATS shares; an empty text has none."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    t = _class_tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, upper, digit, space = (t[k][code] for k in ("letter", "upper", "digit", "space"))
    c = np.where(digit, 48, np.where(upper & (code < 128), code + 32, np.where(space & (code != 10), 32, code))).astype(np.uint64)
    counts, shift = np.zeros(DIM, np.int64), np.uint64(64 - BITS)
    for k in range(0, len(c), CHUNK):
        part = c[k:k + CHUNK + 2]
        one = part * _A
        two = one[:-1] * _B + part[1:]
        three = two[:-1] * _C + part[2:]
        for h in (one, two, three):
            counts += np.bincount((h[:CHUNK] * _MIX >> shift).astype(np.int32), minlength=DIM)
    at = np.flatnonzero(counts)
    x = 1 + np.log(counts[at])
    x /= np.sqrt(x @ x)
    n = len(code)
    starts = ~space & np.concatenate(([True], space[:-1]))
    words = max(1, int(starts.sum()))
    ends = np.append(np.flatnonzero(code == 10), n)
    line = np.diff(np.concatenate(([-1], ends))) - 1
    mark = ~(letter | digit | space)
    share = np.array([1.0, letter.mean(), upper.sum() / max(1, letter.sum()), digit.mean(), space.mean(), mark.mean(), min(1.0, n / words / 20),
                      np.mean(line < 30), min(1.0, line.std() / (line.mean() + 1)), len(np.unique(code)) / 256 if n > 256 else len(np.unique(code)) / n,
                      min(1.0, np.log1p(words) / 12), float((mark[1:] & mark[:-1]).sum()) / n])
    return np.concatenate((at, DIM + np.arange(STATS))), np.concatenate((x, np.minimum(share, 1.0)))


def meta_view(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Features of the page metadata: hashed source, language, size class and pairs of them.
    Missing values are values of their own."""
    size = "null" if n_chars is None or n_chars != n_chars else str(int(np.log2(max(1, n_chars)) * 2))
    words = [f"s={source}", f"l={lang}", f"n={size}", f"sl={source},{lang}", f"ln={lang},{size}", f"sn={source},{size}"]
    at = np.array(sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) % META for w in words}), np.int64)
    return at, np.full(len(at), 1 / np.sqrt(len(at)))


def fit(rows, labels, weights, dim: int, alpha=0.3, beta=1.0, l1=0.01, l2=0.05, epochs=3, seed=7) -> np.ndarray:
    """Logistic regression by follow-the-regularised-leader; the last weight is the bias."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = np.append(rows[k][0], dim), np.append(rows[k][1], 1.0)
            zz, nn = z[at], n[at]
            w = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - labels[k]) * weights[k] * x
            z[at] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def logits(rows, w: np.ndarray) -> np.ndarray:
    return np.array([x @ w[at] + w[-1] for at, x in rows])


def _newton(x: np.ndarray, y: np.ndarray, ridge=1.0) -> np.ndarray:
    """Small logistic regression with a bias in the last column of x."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * 1e-2 * w)
    return w


DIMS = (DIM + STATS, META)


def turn_of(doc_id, rounds: int):
    """The round whose pool a document without a label is in."""
    return F.pmod(F.xxhash64(F.lit(6), doc_id), F.lit(max(1, rounds)))


def begin(views: tuple[list, list], y: np.ndarray):
    """Which labelled rows are held for calibration, and what each view learns from at first."""
    held = np.arange(len(y)) % 5 == 4
    return held, [([v[k] for k in np.flatnonzero(~held)], list(y[~held]), [1.0] * int((~held).sum())) for v in views]


def shares(rate: float, given: int) -> tuple[int, int]:
    """Good and bad documents that a view names in a round; good ones are ``rate`` of all."""
    return round(given * rate), max(1, round(given * (1 - rate)))


def taught(sets, view: int, row, label: float) -> None:
    """A pseudo-label counts half."""
    for column, value in zip(sets[view], (row, label, 0.5)):
        column.append(value)


def calibrate(views: tuple[list, list], y: np.ndarray, held: np.ndarray, weights):
    """A scale and shift that calibrate each view, and the weights of their combination."""
    if not held.any() or not 0 < y[held].mean() < 1:
        return [np.array([1.0, 0.0])] * 2, np.array([1.0, 1.0, 0.0])
    raw = [logits([views[v][k] for k in np.flatnonzero(held)], weights[v]) for v in (0, 1)]
    ones = np.ones(held.sum())
    scales = [_newton(np.stack((r, ones), 1), y[held]) for r in raw]
    both = _newton(np.stack([np.clip(s[0] * r + s[1], -8, 8) for s, r in zip(scales, raw)] + [ones], 1), y[held])
    return scales, both


def co_train(views: tuple[list, list], y: np.ndarray, pools: tuple[list, list], rounds: int = ROUNDS, given: int = GIVEN, turn: np.ndarray | None = None):
    """Weights of both views, a scale and shift that calibrate each, and of the combination.

    views: features of the labelled rows in each view, pools: of unlabelled ones, all in
    memory; turn: the round of each unlabelled row, else pools are equal slices."""
    held, sets = begin(views, y)
    rate = float(np.mean(y[~held])) if (~held).any() else 0.5
    if turn is None:
        turn = np.arange(len(pools[0])) // max(1, -(-len(pools[0]) // max(1, rounds)))
    for r in range(rounds):
        mine = np.flatnonzero(turn == r)
        if not 0 < rate < 1:
            break
        chosen = []
        for v in (0, 1):
            score = logits([pools[v][k] for k in mine], fit(*sets[v], DIMS[v])) if len(mine) else np.zeros(0)
            order = np.argsort(score, kind="stable")
            good, bad = shares(rate, given)
            chosen.append([(mine[k], 0.0) for k in order[:bad] if score[k] < 0] + [(mine[k], 1.0) for k in order[::-1][:good] if score[k] > 0])
        for v in (0, 1):  # what one view is sure of teaches the other
            for k, label in chosen[1 - v]:
                taught(sets, v, pools[v][k], label)
    weights = [fit(*sets[v], DIMS[v]) for v in (0, 1)]
    return weights, *calibrate(views, y, held, weights)


def _features(batches):
    for b in batches:
        t = [text_view(x) for x in b.text]
        m = [meta_view(*x) for x in zip(b.source, b.lang, b.n_chars)]
        yield pd.DataFrame({"id": b.doc_id.astype(str), "view": b.view, "label": b.label, "turn": b.turn, "place": b.place,
                            "ta": [x[0].astype(np.int32) for x in t], "tx": [x[1].astype(np.float32) for x in t], "ma": [x[0].astype(np.int32) for x in m]})


def _learn(batches):
    """Weights from all rows: labelled ones (no view) and those that are to teach a view."""
    parts = [*batches]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    rows = rows.assign(o=[zlib.crc32(i.encode()) for i in rows["id"]])
    text = lambda x: [(a, v.astype(float)) for a, v in zip(x.ta, x.tx)]
    meta = lambda x: [(a, np.full(len(a), 1 / np.sqrt(len(a)))) for a in x.ma]
    known = rows[rows["view"] < 0].sort_values(["o", "id"])
    y = known["label"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        yield pd.DataFrame({"part": ["share"], "w": [np.array([share])]})
        return
    views = text(known), meta(known)
    held, sets = begin(views, y)
    for v, of in ((0, text), (1, meta)):
        x = rows[rows["view"] == v].sort_values(["turn", "label", "place"])
        for row, label in zip(of(x), x["label"]):
            taught(sets, v, row, label)
    weights = [fit(*sets[v], DIMS[v]) for v in (0, 1)]
    scales, both = calibrate(views, y, held, weights)
    rate = float(y[~held].mean()) if (~held).any() else 0.5
    yield pd.DataFrame({"part": ["text", "meta", "text_scale", "meta_scale", "both", "rate"], "w": [*weights, *scales, both, np.array([rate])]})


def _raw(m: dict, b: pd.DataFrame) -> list[np.ndarray]:
    return [logits([text_view(x) for x in b.text], m["text"]), logits([meta_view(*x) for x in zip(b.source, b.lang, b.n_chars)], m["meta"])]


def _surest(pool: DataFrame, good: int, bad: int) -> list[tuple]:
    """(id, view to teach, label, place) of the documents that each view is surest of: bounded
    heads of orders, ties by a digest of the id and the id itself."""
    name = F.col("doc_id").cast("string")
    digest = F.crc32(name.cast("binary"))
    out = []
    for view, score in ((1, "by_text"), (0, "by_meta")):
        low = pool.where(F.col(score) < 0).orderBy(F.col(score), digest, name).limit(bad)
        high = pool.where(F.col(score) > 0).orderBy(F.col(score).desc(), digest.desc(), name.desc()).limit(good)
        for label, head in ((0.0, low), (1.0, high)):
            out += [(r.doc_id, view, label, k) for k, r in enumerate(head.select("doc_id").collect())]
    return out


def score_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", cut: float = CUT, rounds: int = ROUNDS, given: int = GIVEN) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score (calibrated probabilities of
    good quality from each view), score (combined) and keep (score >= cut).

    Learns from at most LABELLED labelled documents, in the order of a hash of the id, and
    from ``given`` documents that each view is surest of in each of ``rounds`` pools;
    all other documents are dealt to the pools by that hash, and every one is scored there
    and again at the end, on its whole text. Null labels are ignored, and labels
    that disagree count by majority. A null or empty text has no text features; null
    metadata, and that of a table without source, lang or n_chars, is a value of its own.
    Rows without an id are scored and teach nothing; of rows that share one the least
    teaches. Without labels of both classes all scores are the share of good ones,
    or 0.5 without any. Equal rows get equal scores; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    page = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), page("source", "string"), page("lang", "string"), page("n_chars", "double"))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("m_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    ids = d.select("doc_id").distinct()
    known = marks.join(ids, marks.m_id == ids.doc_id, "left_semi").orderBy(F.xxhash64(F.lit(6), "m_id"), "m_id").limit(LABELLED)

    def featured(picked: DataFrame, turn: int) -> DataFrame:
        """Features of the documents in ``picked`` (m_id, view, label, place), a bounded table."""
        rows = d.join(F.broadcast(picked.select("m_id").distinct()), F.col("doc_id") == F.col("m_id")).groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("one"))
        rows = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("m_id")).select("doc_id", "one.*", "view", "label", F.lit(turn).alias("turn"), "place")
        return materialise(rows.mapInPandas(_features, "id string, view int, label double, turn int, place int, ta array<int>, tx array<float>, ma array<int>"))

    def learned() -> dict:
        rows = reduce(DataFrame.unionByName, lessons).repartition(1)
        found = rows.mapInPandas(_learn, "part string, w array<double>").toPandas()
        return {p: np.array(w) for p, w in zip(found.part, found.w)} or {"share": np.array([0.5])}

    picked = materialise(known.select("m_id", F.lit(-1).alias("view"), F.col("y").alias("label"), F.lit(0).alias("place")))
    lessons = [featured(picked, -1)]
    parts = learned()
    for r in range(rounds if "share" not in parts else 0):
        model = spark.sparkContext.broadcast(parts)

        def sure(batches, model=model):
            for b in batches:
                by_text, by_meta = _raw(model.value, b)
                yield pd.DataFrame({"doc_id": b.doc_id, "by_text": by_text, "by_meta": by_meta})

        mine = d.where(F.col("doc_id").isNotNull() & (turn_of(F.col("doc_id"), rounds) == r))
        scored = mine.mapInPandas(sure, f"doc_id {kind}, by_text double, by_meta double").groupBy("doc_id").agg(F.min("by_text").alias("by_text"), F.min("by_meta").alias("by_meta"))
        pool = materialise(scored.join(marks, scored.doc_id == marks.m_id, "left_anti"))
        chosen = _surest(pool, *shares(float(parts["rate"][0]), given))
        discard(pool)
        if chosen:
            lessons.append(featured(spark.createDataFrame(chosen, f"m_id {kind}, view int, label double, place int"), r))
            parts = learned()
    discard(picked, *lessons)
    model = spark.sparkContext.broadcast(parts)

    def score(batches):
        m = model.value
        for b in batches:
            if "share" in m:
                p = np.full((3, len(b)), m["share"][0])
            else:
                z = [np.clip(m[k][0] * r + m[k][1], -8, 8) for k, r in zip(("text_scale", "meta_scale"), _raw(m, b))]
                z.append(m["both"][0] * z[0] + m["both"][1] * z[1] + m["both"][2])
                p = 1 / (1 + np.exp(-np.array(z)))
            yield pd.DataFrame({"doc_id": b.doc_id, "text_score": p[0], "meta_score": p[1], "score": p[2], "keep": p[2] >= cut})

    return d.mapInPandas(score, f"doc_id {kind}, text_score double, meta_score double, score double, keep boolean")


def op6_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
