import random

import corpus_pipeline as P
import numpy as np
from data import clashing, corpus, frame, prose, row

from labelq.llm import shingles as H
from labelq.llm import simhash as S


def brute(rows):
    """Components of all pairs whose sets of shingles, as tuples of words, are 0.8 similar."""
    def cut(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(i, cut(t)) for i, t in rows]
    group = {i: i for i, _ in sets}
    alike = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b))
    links = [(i, j) for i, a in sets for j, b in sets if alike(a, b)]
    for _ in group:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group


def copies(seed=3):
    """Texts with near copies of a few changed words; a chain whose ends are far apart."""
    rng = random.Random(seed)
    rows = []
    for g in range(8):
        words = prose(rng, rng.choice([40, 120, 300])).split()
        for c in range(9):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                new[rng.randrange(len(new))] = f"other{rng.randrange(999)}"
            rows.append(row(100 * g + c, " ".join(new)))
    words = prose(rng, 200).split()
    for c in range(30):
        rows.append(row(2000 + c, " ".join(words)))
        words[rng.randrange(200)] = f"step{c}"
        words[rng.randrange(200)] = f"pace{c}"
    return rows


def components(spark, rows, **kw):
    return {r.doc_id: r.component_id for r in S.near_texts(frame(spark, rows), **kw).collect()}


def test_stage_finds_all_pairs_of_a_brute_force_join(spark):
    rows = copies()
    want = brute([r[:2] for r in rows])
    kept = {r.doc_id for r in P.near_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == set(want.values()) and len(kept) < len(rows) / 2
    assert components(spark, rows) == want


def test_crowded_buckets_are_worked_off(spark):
    rows = copies(9)
    got = components(spark, rows, least=0.95)  # most that meet do not link
    sets = {i: np.unique(H.shingle_hashes(t, 5)) for i, t, *_ in rows}
    group = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if H.similarity(sets[i], sets[j]) >= 0.95]
    for _ in range(len(group)):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    assert got == group


def test_awkward_tables(spark):
    rows = corpus()
    got = components(spark, rows)
    assert got == brute([r[:2] for r in rows])
    assert {r.doc_id: r.component_id for r in S.near_texts(clashing(frame(spark, rows))).collect()} == got
    assert S.near_texts(frame(spark, [])).count() == 0
    twice = [row(None, "a b c d e f"), row(1, "a b c d e f"), row(1, "other words stand here now")]
    kept = S.one_of_each(frame(spark, twice), find=S.near_texts).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d e f"), (1, "other words stand here now")]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n in (0, 1, 30, 400):
        a = rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate((a[n // 5:], rng.integers(0, 2 ** 63, n // 5, dtype=np.uint64) * np.uint64(2)))
        bits = sum(int(x).bit_count() for x in (H.parity(a) ^ H.parity(b)).view(np.uint64))
        assert len(H.parity(a)) == H.MARKS and bits <= len(np.setxor1d(a, b))


def test_many_pairs_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL", 5)
    rows = copies(4)
    assert components(spark, rows) == brute([r[:2] for r in rows])
