import random

import pytest
from data import clashing, corpus, frame, prose, row

from labelq.llm import substrings as S


@pytest.mark.parametrize("seed", range(40))
def test_shard_by_definition(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(1, 6))]
    weights = [rng.choice([1, 1, 2]) for _ in parts]
    seen = {}
    for p, w in zip(parts, weights):
        for k in range(len(p) - 19):
            seen[p[k:k + 20]] = seen.get(p[k:k + 20], 0) + w
    want = [S.merge((k, k + 20) for k in range(len(p) - 19) if seen[p[k:k + 20]] > 1) for p in parts]
    assert [S.merge(x) for x in S.repeated(parts, weights, 20)] == want


@pytest.mark.parametrize("seed", range(6))
def test_buckets_are_in_suffix_order(seed):
    rng = random.Random(seed)
    word = bytes(rng.choice(b"abc") for _ in range(50))
    data = b"".join(rng.choice([word, word[:20], bytes([rng.choice(b"abc")])]) for _ in range(rng.choice([20, 200])))
    p = S.sort_buckets(__import__("numpy").frombuffer(data, "u1"), 40)
    order = sorted(range(len(data) - 39), key=lambda i: (p[i], i))
    cut = [data[i:i + 40] for i in order]
    assert cut == sorted(cut)
    assert all(data[i:i + 40] == data[j:j + 40] for i, j in zip(order, order[1:]) if p[i] == p[j])


@pytest.mark.parametrize("seed", range(4))
def test_parts_of_a_stretch_hold_each_window_once(seed):
    data = prose(random.Random(seed), 300).encode()
    start, length, h = (x.tolist() for x in next(S.stretches(data)))
    for a, n, name in list(zip(start, length, h))[:40]:
        todo, seen = [(0, data[a:a + n], -1, -1, name, 0)], []
        while todo:
            at, part, left, right, key, level = todo.pop()
            if level == 9:
                seen += [at + k for k in range(len(part) - S.WIDTH + 1)]
                assert part[left:right] in data and (right - left == S.WIDTH) and len(part) == S.WIDTH
                continue
            for s, sub, x, y, k in S.split_stretch(part, key, left, right):
                assert y - x > right - left or right - left == S.WIDTH
                todo.append((at + s, sub, x, y, k, level + 1))
        assert sorted(seen) == list(range(n - S.WIDTH + 1))


def test_stretches_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 512)
    data = prose(random.Random(2), 700).encode()
    windows = [k for start, length, _ in S.stretches(data) for a, n in zip(start, length) for k in range(a, a + n - S.WIDTH + 1)]
    assert sorted(windows) == list(range(len(data) - S.WIDTH + 1))
    assert list(S.stretches(data[:199])) == []


def documents():
    rng = random.Random(8)
    passage = prose(rng, 70)
    rows = [row(i, prose(rng, rng.choice([10, 60, 120]))) for i in range(20)]
    rows += [row(50 + i, prose(rng, 20) + passage + prose(rng, 20)) for i in range(6)]
    rows += [row(70, rows[1][1]), row(71, passage[20:400]), row(72, "é" * 350), row(73, "ab" * 300), row(74, prose(rng, 30) * 3), row(75, "z" * 200), row(76, "z" * 199)]
    return rows + corpus(3, 12)[-8:]


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_against_brute_force(spark, hot):
    rows = [(k, *r[1:]) for k, r in enumerate(documents())]
    import hashlib

    got = {r.doc_id: (r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in S.remove_repeats(frame(spark, rows), hot=hot).collect()}
    want = dict(zip((r[0] for r in rows), S.brute_force([r[1] for r in rows])))
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_awkward_tables(spark):
    text = prose(random.Random(1), 80)
    rows = [row(None, text), row(1, text), row(1, text), row(2, None), row(2, "")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), len(r.kept)) for r in S.remove_repeats(clashing(frame(spark, rows))).collect())
    assert got == [((False, 1), 0), ((False, 1), 0), ((False, 2), 0), ((False, 2), 0), ((True, 0), 0)]
    many = [row(7, text)] * 300 + [row(8, prose(random.Random(3), 90))]
    docs, ranges = S.repeated_ranges(frame(spark, many))
    assert max(len(r.ranges) for r in ranges.collect()) < 200
    assert {(r.doc_id, len(r.kept) == 0, len(r.spans)) for r in S.remove_repeats(frame(spark, many)).collect()} == {(7, True, 1), (8, False, 0)}
    alone = [row(None, text), row(3, prose(random.Random(2), 80))]
    assert all(len(r.kept) == r.n_bytes for r in S.remove_repeats(frame(spark, alone)).collect())
    assert S.remove_repeats(frame(spark, [])).count() == 0
