import math
import random
import zlib
from collections import Counter

import numpy as np
from data import WORDS, clashing, corpus, frame, prose, row

from labelq.llm import langid as G


def table(n=240):
    rng = random.Random(1)
    return [row(i, prose(rng, rng.randint(2, 60), lang), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_held_out_accuracy(spark):
    rows = table() + corpus()[-5:]
    got = {r.doc_id: r for r in G.identify(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    known = [r for r in held if r[2]]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in known]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[r[0]].lang_pred for r in rows if r[1] in (None, "", " \n\t\n", "12 34 -- ??")] == ["und"] * 4


def test_held_out_rows_teach_nothing(spark):
    rows = table(90)
    lie = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in G.identify(frame(spark, x)).collect()} for x in (rows, lie))
    assert a == b


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(3), 500, "fr")
    at, n = G.ngrams(text)
    monkeypatch.setattr(G, "CHUNK", 64)
    assert np.array_equal(G.ngrams(text)[0], at) and np.array_equal(G.ngrams(text)[1], n)


def test_ftrl_is_sparse_and_temperature_calibrates():
    g = np.random.default_rng(0)
    rows = [(np.array([y, 2 + int(g.integers(50))]), np.ones(2), y) for y in g.integers(0, 2, 300)]
    w = G.fit_ftrl(rows, 2, l1=1.0)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[2:52] == 0).mean() > 0.3
    logits = g.normal(0, 1, (4000, 3)) * 4
    y = np.array([g.choice(3, p=G._softmax(z / 2)) for z in logits])
    assert abs(G.fit_temperature(logits, y) - 2) < 0.2


def test_awkward_tables(spark):
    assert G.identify(frame(spark, [])).count() == 0
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in table(8)]
    assert {r.lang_pred for r in G.identify(frame(spark, unlabelled)).collect()} == {"und"}
    df = clashing(frame(spark, table(40) + [row(None, "the river", "en")] + table(3)))
    out = G.identify(df).collect()
    assert len(out) == 44 and set(out[0]["row"].asDict()) == set(df.columns)


def plain_grams(text):
    """Counts of hashed n-grams of one to three characters, one by one."""
    text, out, last = (text or "").lower(), [], False
    for c in text:
        if c.isalpha() or last:
            out.append(c if c.isalpha() else " ")
        last = c.isalpha()
    if not any(c != " " for c in out):
        return Counter()
    codes, mask = [32, *map(ord, out), 32], 2 ** 64 - 1
    a, b, c, mix = (int(x) for x in (G._A, G._B, G._C, G._MIX))
    found = Counter()
    for k, x in enumerate(codes):
        one = x * a & mask
        grams = [one]
        if k + 1 < len(codes):
            two = (one * b + codes[k + 1]) & mask
            grams.append(two)
            if k + 2 < len(codes):
                grams.append((two * c + codes[k + 2]) & mask)
        found.update((h * mix & mask) >> (64 - G.BITS) for h in grams)
    return found


def plain_model(rows, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
    """(languages, predict) learned coordinate by coordinate over the whole vocabulary."""
    grams = [plain_grams(t) for _, t, _ in rows]
    n = sum(bool(g) for g in grams)
    df = Counter(h for g in grams for h in g)
    idf = {h: math.log((1 + n) / (1 + k)) + 1 for h, k in df.items()}
    base = math.log(1 + n) + 1

    def weigh(g):
        x = {h: (1 + math.log(k)) * idf.get(h, base) for h, k in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {h: v / norm for h, v in x.items()}

    known = sorted((str(i), lang, weigh(g)) for (i, _, lang), g in zip(rows, grams) if g)
    languages = sorted({lang for _, lang, _ in known})
    data = [(x | {"bias": 1.0}, languages.index(lang)) for _, lang, x in known]
    words = sorted({h for x, _ in data for h in x if h != "bias"}) + ["bias"]
    z, m = ({(h, k): 0.0 for h in words for k in range(len(languages))} for _ in range(2))

    def weight(h, k):
        if abs(z[h, k]) <= l1:
            return 0.0
        return -(z[h, k] - math.copysign(l1, z[h, k])) / ((beta + math.sqrt(m[h, k])) / alpha + l2)

    def chances(x, t=1.0):
        s = [sum(v * weight(h, k) for h, v in x.items() if (h, k) in z) / t for k in range(len(languages))]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    fitted = [d for k, d in enumerate(data) if k % 5 != 4]
    rng = np.random.default_rng(7)
    for _ in range(3):
        for i in rng.permutation(len(fitted)):
            x, y = fitted[i]
            p = chances(x)
            w = {(h, k): weight(h, k) for h in x for k in range(len(languages))}
            for h, v in x.items():
                for k in range(len(languages)):
                    g = v * (p[k] - (k == y))
                    sigma = (math.sqrt(m[h, k] + g * g) - math.sqrt(m[h, k])) / alpha
                    z[h, k] += g - sigma * w[h, k]
                    m[h, k] += g * g
    held = [d for k, d in enumerate(data) if k % 5 == 4]
    grid = np.exp(np.linspace(-3, 3, 601))
    t = min(grid, key=lambda t: sum(-math.log(chances(x, t)[y] + 1e-12) for x, y in held))

    def predict(text):
        g = plain_grams(text)
        if not g:
            return "und", 0.0
        p = chances(weigh(g) | {"bias": 1.0}, t)
        k = max(range(len(p)), key=lambda k: (p[k], -k))
        return languages[k], p[k]

    return predict


def test_against_a_plain_model(spark):
    rng = random.Random(4)
    rows = [row(i, prose(rng, rng.choice([2, 4, 9]), lang), lang) for i in range(45) for lang in [list(WORDS)[i % 3]]] + corpus()[-5:]
    learn = [(r[0], r[1], r[2]) for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    predict = plain_model(learn)
    for r in G.identify(frame(spark, rows)).collect():
        lang, score = predict(r["row"].text)
        assert abs(score - r.score) < 0.02 and (lang == r.lang_pred or score < 0.4)


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS_PER_LANGUAGE", 10)
    rows = [row(1, f"{prose(random.Random(k), 5)}", "en") for k in range(40)] + [row(None, prose(random.Random(k), 5, "fr"), "fr") for k in range(40)] + [row(9, "der fluss", "de")] * 30
    model = G.train(frame(spark, rows).select("doc_id", "text", "lang"))
    assert model.languages == ["de", "en", "fr"] and model.predict("la maison et le jardin")[0] == "fr"
    monkeypatch.setattr(G, "ROWS", 2)
    assert len(G.train(frame(spark, rows).select("doc_id", "text", "lang")).languages) == 3
