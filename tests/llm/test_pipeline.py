import random

import corpus_pipeline as P
import pytest
from data import corpus, frame, prose, row

from labelq.llm import decontam as D
from labelq.llm import langid as G
from labelq.llm import lines as L

ITEM = "Every river under the winter light carries stones over the garden path in the morning, and paper boats follow them."


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(6)
    shared = prose(rng, 14).replace("\n", " ")
    rows = corpus(n=60) + [row(100 + i, prose(rng, 30) + "\n" + shared) for i in range(6)] + [row(110, prose(rng, 20) + "\n" + ITEM), row(111, prose(rng, 25))]
    frame(spark, rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def step(spark, sf, docs, name):
    out = P.common.materialise(dict(P.STAGES)[name](spark, docs, sf))
    return out, {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()}


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    docs, before, after = step(spark, sf, docs, "language_id")
    assert set(before) - set(after) == {i for i, t in before.items() if not len(G.ngrams(t)[0])}
    assert docs.columns == columns

    docs, before, after = step(spark, sf, docs, "line_dedup")
    want = {i: kept for i, n, _, kept in L.brute_force(list(before.items())) if not n or kept.strip()}
    assert {i: r.text for i, r in after.items()} == want and docs.columns == columns
    assert all(r.n_chars == len(r.text) for r in after.values())

    docs, before, after = step(spark, sf, docs, "near_dedup")
    words = {i: t.lower().split() for i, t in before.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min(group[j] for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
    assert set(after) == set(group.values()) < set(before) and docs.columns == columns

    docs, before, after = step(spark, sf, docs, "decontaminate")
    assert set(before) - set(after) == {i for i, t in before.items() if ITEM in t} == {110} and docs.columns == columns
    assert not any(D.template(ITEM)["exact"][:3].tolist() == D.template(r.text)["exact"][:3].tolist() for r in after.values())

    docs, before, after = step(spark, sf, docs, "mix")
    assert set(after) <= set(before) and all(0 < r.taken <= 3 * r["size"] and r.text == before[r.doc_id] for r in after.values())
    total = sum(len(t.split()) for t in before.values())
    assert abs(sum(r.taken for r in after.values()) - total) < 0.02 * total


def test_languages_that_no_row_teaches_go(spark):
    """On a table whose calibration rows the model does not get all right. Where it does, as on
    tables of a few hundred rows, it is sure of any text with letters and the stage keeps them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    foreign = ["Сегодня утром мы идём по мокрому саду, а над рекой ещё стоит туман и молчат птицы.", "今日は天気がいいですね。公園へ行きましょう",
               "Kissa nukkuu tuolilla kun sade putoaa vanhan talon katolle ja lapset lukevat", "12 34 56 a 78 90 -- 44 b 22"]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in P.language_id(spark, every, "").select("doc_id").collect()}
    assert not any(i < 0 for i in kept)
    told = {r.doc_id for r in docs.collect() if len(G.ngrams(r.text)[0])}
    assert kept == told


def test_run_is_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, f in P.STAGES:
        docs = P.common.materialise(f(spark, docs, sf))
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, tmp_path, sf):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
