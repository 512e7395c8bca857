"""One very long text among short ones, through every operator."""

import random

import pytest
from data import frame, prose, row

from labelq.llm import decontam, langid, lines, media, mixing, quality, secrets, simhash, substrings

N = 400_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    text = prose(rng, N)
    rows = [row(i, prose(rng, 30)) for i in range(20)] + [row(20, text), row(21, text[1000:3000]), row(22, "x" * 2_000_000), row(23, "password = abcdefgh " * 20_000)]
    return frame(spark, rows).cache()


def test_all(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    bench = spark.createDataFrame([(0, docs.where("doc_id = 21").first().text[200:500])], "item_id long, text string")
    assert lines.dedup_lines(docs).count() == 24
    assert {20, 21} <= {r.doc_id for r in decontam.find_contaminated(docs, bench).collect()}
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}[20] == "en"
    assert secrets.scan_secrets(docs).selectExpr("doc_id", "size(found) n").where("doc_id = 23").first().n == 20_000
    assert simhash.near_duplicates(docs).count() == 24
    assert quality.score_quality(docs, labels).count() == 24
    taken = {r.doc_id: r for r in mixing.mix_sources(docs).taken.collect()}
    assert taken[20]["size"] == N and taken[20].taken == N
    rows, index, folder = media.media_columns(docs)
    assert media.read_payloads(index, folder).count() == 24
    kept = {r.doc_id: len(r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert kept[22] == 0 and kept[21] == 0 and 0 < kept[20] < len(docs.where("doc_id = 20").first().text)
