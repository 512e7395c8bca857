import random
import zlib

import numpy as np
from data import clashing, corpus, frame, prose, row
from pyspark.sql import functions as F

from labelq.llm import quality as Q


def noisy(rng, text):
    return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())


def table(n=160):
    rng = random.Random(0)
    rows, y = [], {}
    for i in range(n):
        bad = i % 4 == 0
        t = prose(rng, rng.randint(10, 80))
        rows.append(row(i, noisy(rng, t) if bad else t, source=f"s{8 if bad and i % 8 else i % 3}"))
        y[i] = int(not bad)
    return rows, y


def labels(spark, y, ids):
    return spark.createDataFrame([(i, y[i]) for i in ids], "doc_id long, quality int")


def test_unlabelled_rows_are_scored_right(spark):
    rows, y = table()
    got = {r.doc_id: r for r in Q.score_quality(frame(spark, rows), labels(spark, y, range(100))).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.keep == (r.score >= Q.CUT) for r in got.values())
    assert np.mean([got[i].keep == bool(y[i]) for i in range(100, 160)]) > 0.95
    again = {r.doc_id: r.score for r in Q.score_quality(frame(spark, rows[::-1]).repartition(5), labels(spark, y, range(100))).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)


def test_views_teach_each_other():
    """The metadata view has labels of one kind only; the text view's pseudo-labels bring the other."""
    rng = np.random.default_rng(0)
    y = np.array([1.0, 0.0] * 40)
    text = [(np.array([int(v), 5 + int(rng.integers(20))]), np.ones(2)) for v in y]
    blank = [(np.array([7]), np.ones(1)) for _ in y]
    pool_y = rng.integers(0, 2, 400)
    pool_text = [(np.array([int(v), 5 + int(rng.integers(20))]), np.ones(2)) for v in pool_y]
    pool_meta = [(np.array([100 + int(v)]), np.ones(1)) for v in pool_y]
    (_, meta), _, _ = Q.co_train((text, blank), y, (pool_text, pool_meta), rounds=3, given=40)
    assert meta[101] > meta[100]
    (_, alone), _, _ = Q.co_train((text, blank), y, ([], []), rounds=3, given=40)
    assert alone[101] == alone[100] == 0


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(1), 300) + "###"
    a = Q.text_view(text)
    monkeypatch.setattr(Q, "CHUNK", 50)
    b = Q.text_view(text)
    assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])


def test_awkward_tables(spark):
    rows, y = table(40)
    rows = rows + corpus(n=12) + [row(None, "some text", None, None), (700, None, None, None, None)]
    rows = [(100 + k, *r[1:]) if k >= 40 and r[0] is not None else r for k, r in enumerate(rows)]
    lab = spark.createDataFrame([*((i, v) for i, v in y.items()), (1, 0), (1, 1), (2, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    assert Q.score_quality(clashing(frame(spark, rows)), lab).where("score between 0 and 1").count() == len(rows)
    assert Q.score_quality(frame(spark, []), lab).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(frame(spark, rows[:5]), none).collect()} == {0.5}
    same = labels(spark, {i: 1 for i in y}, y)
    assert {r.score for r in Q.score_quality(frame(spark, rows[:5]), same).collect()} == {1.0}


def test_scores_equal_the_plain_model(spark):
    """Pools over the whole table against the same rounds on lists of one process."""
    rows, y = table(200)
    df, marked = frame(spark, rows), range(90)
    got = {r.doc_id: r for r in Q.score_quality(df, labels(spark, y, marked), rounds=3, given=12).collect()}
    turn = {r[0]: r[1] for r in df.select("doc_id", Q.turn_of(df.doc_id, 3)).collect()}
    of = {r.doc_id: (Q.text_view(r.text), Q.meta_view(r.source, r.lang, r.n_chars)) for r in df.collect()}
    order = sorted(of, key=lambda i: (zlib.crc32(str(i).encode()), str(i)))
    a, b = [i for i in order if i in marked], [i for i in order if i not in marked]
    # training keeps text features as floats of four bytes
    small = lambda i: (of[i][0][0], of[i][0][1].astype(np.float32).astype(float))
    weights, scales, both = Q.co_train(([small(i) for i in a], [of[i][1] for i in a]), np.array([float(y[i]) for i in a]), ([of[i][0] for i in b], [of[i][1] for i in b]),
                                       rounds=3, given=12, turn=np.array([turn[i] for i in b]))
    z = [np.clip(s[0] * Q.logits([of[i][v] for i in order], w) + s[1], -8, 8) for v, (s, w) in enumerate(zip(scales, weights))]
    want = 1 / (1 + np.exp(-(both[0] * z[0] + both[1] * z[1] + both[2])))
    assert max(abs(got[i].score - w) for i, w in zip(order, want)) < 1e-4


def test_fit_equals_a_dense_model():
    """Follow-the-regularised-leader with all coordinates in one dense vector."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(60)]
    y, weight = rng.integers(0, 2, 60).astype(float), rng.choice([0.5, 1.0], 60)
    z, n, g2 = np.zeros(13), np.zeros(13), np.random.default_rng(7)

    def solve(z, n):
        return np.where(np.abs(z) > 0.01, -(z - 0.01 * np.sign(z)) / ((1.0 + np.sqrt(n)) / 0.3 + 0.05), 0.0)

    for _ in range(3):
        for k in g2.permutation(60):
            x = np.zeros(13)
            x[rows[k][0]], x[12] = rows[k][1], 1.0
            w = solve(z, n)
            g = weight[k] * (1 / (1 + np.exp(-w @ x)) - y[k]) * x
            z, n = z + g - (np.sqrt(n + g**2) - np.sqrt(n)) / 0.3 * w, n + g**2
    assert np.allclose(Q.fit(rows, y, weight, 12), solve(z, n))


def test_pools_hold_every_document_without_a_label(spark):
    rows, _ = table(120)
    turns = [r[0] for r in frame(spark, rows).select(Q.turn_of(F.col("doc_id"), 4)).collect()]
    assert set(turns) == {0, 1, 2, 3}


def test_tables_without_metadata(spark):
    rows, y = table(80)
    df = frame(spark, rows).select("doc_id", "text")
    got = {r.doc_id: r for r in Q.score_quality(df, labels(spark, y, range(60))).collect()}
    assert len(got) == 80 and np.mean([got[i].keep == bool(y[i]) for i in range(60, 80)]) > 0.8
