import random

import pytest
from data import clashing, corpus, frame, prose, row

from labelq.llm import lines as L


def mutate(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, what = rng.randint(0, len(s)), rng.randint(0, 2)
        if what == 0:
            s.insert(i, rng.choice("abcé"))
        elif i < len(s):
            s[i:i + 1] = [] if what == 1 else [rng.choice("abcx")]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_segments_and_sketch_lose_no_pair(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    b = [mutate(rng, x, rng.randint(0, edits + 2)) for x in a]
    want = [L.distance(x, y) for x, y in zip(a, b)]
    assert L.within(a, b, edits).tolist() == [min(d, edits + 1) for d in want]
    for x, y, d in zip(a, b, want):
        assert bin(int(L.sketches(x)[1][0]) ^ int(L.sketches(y)[1][0])).count("1") <= 4 * d
        s, t = sorted((x, y), key=len)
        if d <= edits < len(s):
            assert {(k, s[i:i + n]) for k, i, n in L.index_plan(len(s), edits)} & {(k, t[i:i + n]) for k, i, n in L.probe_plan(len(t), edits)}


def documents(seed=4):
    rng = random.Random(seed)
    base = [prose(rng, 12).replace("\n", " ") for _ in range(12)]
    rows = []
    for i in range(30):
        part = [mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 9])) for _ in range(rng.randint(1, 5))]
        rows.append(row(i, "\n".join([*part, rng.choice(["", "short line", "é" * 25])])))
    return rows + [row(90, None), row(91, ""), row(92, "\n\n"), row(93, base[0] * 300)]


def test_against_brute_force(spark):
    rows = documents()
    got = {r.doc_id: (r.n_removed, r.n_links, r.kept) for r in L.dedup_lines(frame(spark, rows)).collect()}
    want = {i: (n, k, kept) for i, n, k, kept in L.brute_force([(r[0], r[1]) for r in rows])}
    assert got == want and sum(v[0] for v in want.values()) > 10


def test_awkward_tables(spark):
    rows = corpus()
    plain = {r.doc_id: r.kept for r in L.dedup_lines(frame(spark, rows)).collect()}
    df = clashing(frame(spark, rows))
    assert {r.doc_id: r.kept for r in L.dedup_lines(df).collect()} == plain
    assert L.dedup_lines(frame(spark, [])).count() == 0
    assert set(L.dedup_lines(df).first()["row"].asDict()) == set(df.columns)


def test_null_ids_and_repeated_rows(spark):
    line = "the same long line of text"
    rows = [row(None, line), row(1, line), row(1, line), row(2, line + "\n" + line)]
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_removed, r.kept) for r in L.dedup_lines(frame(spark, rows)).collect()))
    assert got == [(False, 0, 0, line), (True, 1, 1, ""), (True, 1, 1, ""), (True, 2, 2, "")]


def test_repeated_rows_link_once(spark):
    a, b = "the river under the winter light", "the river under the winter lights"
    rows = [row(1, a)] * 3 + [row(2, b)] + [row(3, "words of its own stand in this line here")] * 50
    got = {(r.doc_id, r.n_removed, r.n_links) for r in L.dedup_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0, 1), (2, 1, 1), (3, 0, 0)}
