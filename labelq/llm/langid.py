"""Language identification (operator 3).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by a
temperature. Document frequencies cover every training row; the regression is
fitted on a bounded sample of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelq.llm.common import maybe_broadcast, materialise, small_batches, table, text_key

#: Hashed n-grams of one to three characters.
BITS = 15
DIM = 1 << BITS
UND = "und"
#: Characters that are hashed at once.
CHUNK = 1 << 20
#: Training rows of one language, and of all languages, that the regression is fitted on at most;
#: a fifth of them calibrate. With more languages than ROWS each has one row.
ROWS_PER_LANGUAGE, ROWS = 1500, 12000
_A, _B, _C, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their counts; none without a letter.
    Runs of anything but letters count as one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint64)
    shift, counts = np.uint64(64 - BITS), np.zeros(DIM, np.int64)
    for k in range(0, len(c), CHUNK):  # an n-gram counts in the chunk that it starts in
        part = c[k:k + CHUNK + 2]
        one = part * _A
        two = one[:-1] * _B + part[1:]
        three = two[:-1] * _C + part[2:]
        for h in (one, two, three):
            counts += np.bincount((h[:CHUNK] * _MIX >> shift).astype(np.int32), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=3, seed=7) -> np.ndarray:
    """Weights (DIM + 1, classes) from rows of (index, value, class); the last row is the bias."""
    z, n, w = (np.zeros((DIM + 1, classes)) for _ in range(3))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            zz, nn = z[at], n[at]
            ww = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))
            p = _softmax(x @ ww)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[at] = zz + g - sigma * ww
            n[at] = nn + g * g
    live = np.abs(z) > l1
    w[live] = (-(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))[live]
    return w


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray     #: float32, (DIM + 1, languages)
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = ngrams(text)
        if not len(at) or not self.languages:
            return UND, 0.0
        x = weigh(at, counts, self.idf)
        p = _softmax((x @ self.weights[at] + self.weights[DIM]) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def train(rows: DataFrame) -> Model:
    """Fit a model on rows (doc_id, text, lang). Null languages and texts without a
    letter teach nothing; rows without an id teach like others. With no row left, the model
    answers ``und``."""
    spark = rows.sparkSession
    rows = rows.where("lang is not null")

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.text:
                at, _ = ngrams(t)
                df[at] += 1
                n += len(at) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.append(at, -1), "df": np.append(df[at], n)})

    counts = rows.select("text").mapInPandas(frequencies, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    df, n = np.zeros(DIM), float(counts.df[counts["at"] == -1].sum())
    known = counts[counts["at"] >= 0]
    df[known["at"].to_numpy(int)] = known.df
    idf = np.log((1 + n) / (1 + df)) + 1

    # The rows of least hash in each language; rows alike in id, text and language count once.
    # Where a language has many, a threshold on the hash leaves about four times as many as are
    # wanted, so that no task ranks a whole language.
    rows = rows.withColumn("key", text_key("text"))
    hashed = F.xxhash64("doc_id", "key")
    sizes = materialise(rows.groupBy("lang").agg(F.approx_count_distinct(hashed, 0.02).alias("rows")))
    n_languages = sizes.count()
    most = max(1, min(ROWS_PER_LANGUAGE, ROWS // max(1, n_languages)))
    share = F.least(F.lit(1.0), F.lit(4.0 * most + 64) / F.col("rows"))
    low = rows.select("doc_id", "key", "lang").join(maybe_broadcast(sizes, n_languages, 64), "lang").where(hashed / 2.0 ** 64 + 0.5 <= share)
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id", "key")
    low = low.select("doc_id", "key", "lang").distinct().withColumn("k", F.row_number().over(order))
    picked = materialise(low.where(F.col("k") <= most).select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), F.col("lang").alias("p_lang")))
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key")) & (F.col("lang") == F.col("p_lang"))
    sample = rows.join(maybe_broadcast(picked, picked.count(), 96), same, "left_semi").dropDuplicates(["doc_id", "key", "lang"])

    def features(batches):
        for b in batches:
            grams = [ngrams(t) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id.astype(str), "key": b.key, "lang": b.lang, "at": [g[0].astype(np.int32) for g in grams], "n": [g[1].astype(np.int32) for g in grams]})

    def fit(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        pdf = pdf[pdf["at"].map(len) > 0].sort_values(["doc_id", "key", "lang"]).reset_index(drop=True)
        languages = sorted(pdf.lang.unique())
        data = [(a, weigh(a, c, idf), languages.index(y)) for a, c, y in zip(pdf["at"], pdf.n, pdf.lang)]
        held = [k for k in range(len(data)) if k % 5 == 4]
        if not data:
            yield pd.DataFrame(columns=["language", "weights", "temperature"])
            return
        w = fit_ftrl([r for k, r in enumerate(data) if k % 5 != 4], len(languages)).astype(np.float32)
        t = 1.0
        if held:
            t = fit_temperature(np.array([data[k][1] @ w[data[k][0]] + w[DIM] for k in held]), np.array([data[k][2] for k in held]))
        yield pd.DataFrame({"language": languages, "weights": [w[:, k].tobytes() for k in range(len(languages))], "temperature": t})

    sampled = sample.select("doc_id", "key", "lang", "text").mapInPandas(features, "doc_id string, key long, lang string, at array<int>, n array<int>")
    model = sampled.repartition(1).mapInPandas(fit, "language string, weights binary, temperature double").toPandas().sort_values("language")
    weights = np.stack([np.frombuffer(w, np.float32) for w in model.weights], axis=1) if len(model) else np.zeros((DIM + 1, 0), np.float32)
    return Model(model.language.tolist(), idf, weights, float(model.temperature.iloc[0]) if len(model) else 1.0)


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, text, lang and held_out, and ``row`` with all columns."""
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), row)
    return d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, chance (the score of a guess,
    one over the number of learned languages; 1 without any), and row with all columns of ``docs``.

    Learns from rows with a language whose crc32(id as text) mod 4 is not 2. A
    null text, or one without a letter, is ``und`` with score 0; a null id is not
    held out. Ties go to the language that sorts first. An empty table gives no
    rows; equal rows get equal answers."""
    spark = docs.sparkSession
    small_batches(spark)
    d = _named(docs, id_col, text_col, lang_col)
    learned = train(d.where("not held_out").select("doc_id", "text", "lang"))
    model = spark.sparkContext.broadcast(learned)
    chance = F.lit(1.0 / max(1, len(learned.languages))).alias("chance")

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return d.withColumn("found", predict("text")).select("doc_id", "held_out", "found.lang_pred", "found.score", chance, "row")


def op3_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).drop("chance", "row")
