import numpy as np
import pytest
import xxhash
from data import clashing, corpus, frame, prose, row

from labelq.llm import simhash as S


def slow_print(text):
    words = []
    for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append("".join(c.lower() if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, reach=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= reach:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: min(groups[root(i)]) for i in range(len(prints))}


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A B C D", "É È\x85x y\tZ\x0bq r\r\ns t", "w " * 500, prose(__import__("random").Random(1), 300)])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_all_links(seed, monkeypatch):
    g = np.random.default_rng(seed)
    base = g.integers(0, 2 ** 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in g.choice(64, g.integers(0, 7), replace=False))) for b in base for _ in range(6)]
    points = np.unique(np.concatenate((base, np.array(near, np.uint64), np.arange(40, dtype=np.uint64))))
    monkeypatch.setattr(S, "LEAF", 16)
    monkeypatch.setattr(S, "CELLS", 1 << 10)
    parent = {int(p): int(p) for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(S.BLOCKS):
        block = S.block_of(points, b)
        tree = S.build_tree(block, len(points), 4 // S.BLOCKS, shard=20)
        assert len(tree) > 3
        leaf, at, home = S.deal(block, tree, 4 // S.BLOCKS)
        assert sorted(at[home]) == list(range(len(points)))
        for k in np.unique(leaf):
            m = leaf == k
            p = points[at[m]]
            for x, y in zip(p, p[S.link_forest(p, home[m], 4)]):
                parent[root(int(x))] = root(int(y))
    want = components([int(p) for p in points], list(range(len(points))))
    got = {}
    for i, p in enumerate(points):
        got.setdefault(root(int(p)), []).append(i)
    assert {i: min(v) for v in got.values() for i in v} == want


def test_against_brute_force(spark):
    rows = corpus(n=60) + [row(200 + k, "same words in every copy here") for k in range(5)]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.near_duplicates(frame(spark, rows)).collect()}
    prints = [slow_print(r[1]) for r in rows]
    want = components(prints, [r[0] for r in rows])
    assert got == {r[0]: (p, want[r[0]]) for r, p in zip(rows, prints)}
    kept = {r.doc_id for r in S.one_of_each(clashing(frame(spark, rows))).collect()}
    assert kept == set(want.values())


def test_awkward_tables(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0 and S.one_of_each(frame(spark, [])).count() == 0
    rows = [row(1, "a b"), row(1, "a b"), row(None, "a b"), row(5, None), row(6, "")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.component_id) for r in S.near_duplicates(frame(spark, rows)).collect())
    assert sorted((r.doc_id or 0, r.text) for r in S.one_of_each(clashing(frame(spark, rows))).collect()) == [(1, "a b"), (5, None)]
    assert got == [((False, 1), 1), ((False, 1), 1), ((False, 5), 5), ((False, 6), 5), ((True, 0), 1)]


@pytest.mark.parametrize("find", [S.near_duplicates, S.near_texts])
def test_documents_are_told_apart_by_id_and_text(spark, find):
    a, b = "a river under the winter light carries stones", "paper boats follow the morning over water"
    rows = [row(1, a), row(2, b), row(2, a), row(None, a), row(None, b), row(3, b)] + [row(9, "the same row comes back many times")] * 1000
    kept = S.one_of_each(frame(spark, rows), find=find).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (2, b), (9, rows[-1][1])]
