import hashlib
import re

import pytest
from data import clashing, corpus, frame, prose, row

from labelq.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3)):
    """Shares by weight; what is above three times a source's size is reshared until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def by_hand(rows, golden=M.GOLDEN):
    """Words taken of each document and the first slot that takes any, slot by slot."""
    sizes = {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    t, total = targets(sizes), sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s))
    words, blocks, parts = {}, {}, []
    for s in names:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0]))
        words[s], n = [i for i, text, _ in own for _ in range(size(text))], sizes[s]
        blocks[s] = min(n, max(M.LEAST_BLOCKS, round(n / max(total / M.BLOCKS, 1))))
        parts += [s] * (int(t[s] * blocks[s] / n + 0.5) if n else 0)
    out, first, ranks, sum_, slot = {r[0]: 0 for r in rows}, {r[0]: -1 for r in rows}, dict.fromkeys(names, 0), 0, 0
    while parts and sum_ < total and slot <= len(parts) * M.SPARE + 64:
        s = parts[int((slot * golden % 2 ** 32) / 2 ** 32 * len(parts))]
        k, n = ranks[s], sizes[s]
        ranks[s] += 1
        if k < 3 * blocks[s]:
            b = k % blocks[s]
            for p in range(b * n // blocks[s], (b + 1) * n // blocks[s]):
                i = words[s][p]
                out[i] += 1
                first[i] = slot if first[i] < 0 else first[i]
                sum_ += 1
        slot += 1
    return sizes, t, out, first


def check(spark, rows, df=None):
    mix = M.mix_sources(df if df is not None else frame(spark, rows))
    got = {r.doc_id: r for r in mix.taken.collect()}
    sizes, t, taken, first = by_hand([(r[0], r[1], r[3]) for r in rows])
    assert {i: r.taken for i, r in got.items()} == taken and {i: r.first_slot for i, r in got.items()} == first
    for r in rows:
        g = got[r[0]]
        assert g["size"] == size(r[1]) and g.source_size == sizes[r[3]] and g.target == pytest.approx(t[r[3]]) and g.taken <= 3 * g["size"]
    for s in sizes:
        own = sum(got[r[0]].taken for r in rows if r[3] == s)
        assert abs(own - t[s]) <= max(4, 4 * sizes[s] / M.LEAST_BLOCKS)
    return mix, t


def test_against_brute_force(spark):
    check(spark, corpus(n=60))


def test_the_sequence_decides(spark, monkeypatch):
    rows = corpus(n=60)
    plain = [(r[0], r[1], r[3]) for r in rows]
    got = {r.doc_id: (r.taken, r.first_slot) for r in M.mix_sources(frame(spark, rows)).taken.collect()}
    monkeypatch.setattr(M, "GOLDEN", 2246822519)
    other = {r.doc_id: (r.taken, r.first_slot) for r in M.mix_sources(frame(spark, rows)).taken.collect()}
    _, _, taken, first = by_hand(plain, 2246822519)
    assert other == {i: (taken[i], first[i]) for i in taken} != got
    assert {i: x[0] for i, x in other.items()} != {i: x[0] for i, x in got.items()}


def test_capped_sources_and_buckets(spark, monkeypatch):
    import random

    monkeypatch.setattr(M, "BUCKET_ROWS", 7)
    monkeypatch.setattr(M, "GROUP_BUCKETS", 3)
    rng = random.Random(2)
    rows = [row(i, prose(rng, 40), source="a") for i in range(90)] + [row(100, "one two three", source="b"), row(101, "x", source="c"), row(102, "", source="d"), row(103, None, source=None)]
    _, t = check(spark, rows)
    assert t["b"] == 9.0 and t["c"] == 3.0 and t["d"] == 0.0


def test_schedule_is_even_at_every_length(spark):
    import random

    rng = random.Random(0)
    rows = [row(i, prose(rng, 30), source="abc"[i % 3]) for i in range(60)]
    mix = M.mix_sources(frame(spark, rows))
    order = [r.source for r in mix.schedule.orderBy("slot").collect()]
    share = {s: order.count(s) / len(order) for s in "abc"}
    for n in range(100, len(order), 97):
        for s in "abc":
            assert abs(order[:n].count(s) - n * share[s]) < 14
    ranks = mix.schedule.groupBy("src").agg({"rank": "max", "slot": "count"}).collect()
    assert all(r["max(rank)"] + 1 == r["count(slot)"] for r in ranks)


def test_awkward_tables(spark):
    rows = corpus(n=12)
    check(spark, rows, clashing(frame(spark, rows)))
    assert M.mix_sources(frame(spark, [])).taken.count() == 0
    blank = [row(1, None), row(2, " "), row(None, "")]
    assert [(r["size"], r.target, r.taken) for r in M.mix_sources(frame(spark, blank)).taken.collect()] == [(0, 0.0, 0)] * 3
    twice = [row(1, "a b c"), row(1, "a b c"), row(None, "d e")]
    got = M.mix_sources(frame(spark, twice)).taken.collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 8
