import random
from collections import Counter

from data import clashing, corpus, frame, prose, row

from labelq.llm import decontam as D

ITEM = "Tom has 12 apples and gives 3 kg to Anna after lunch. Later Tom buys 12 pears for $5 each at the market."
OTHER = "Bob has 40 apples and gives 7 lb to Mary after lunch. Later Bob buys 40 pears for $9 each at the market."
MIXED = "Bob has 40 apples and gives 7 lb to Mary after lunch. Later Joe buys 41 pears for $9 each at the market."
ITEMS = [(0, ITEM), (1, "Every river under the winter light carries stones over the garden path in the morning, and paper boats follow them."), (2, None), (3, ""), (4, "too short"), (5, "Water over garden stones")]


def found(spark, docs, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.find_contaminated(docs, bench).collect()}


def cut(text, size):
    """(position, coordinate, words, slot values or None) of all windows, as tuples."""
    t = D.template(text)
    out = []
    for name in ("plain", "named"):
        v = t[name]
        for a in range(len(v["hash"]) - size + 1):
            at = range(a, a + size)
            if sum(not v["slot"][k] for k in at) >= min(size, D.LITERALS) and (name == "plain" or any(v["maybe"][k] for k in at)):
                p = int(v["first"][a])
                out.append((p, int(t["lit"][p]), tuple(v["hash"][k] for k in at), tuple(int(v["value"][k]) for k in at if v["slot"][k])))
    return out + [(a, int(t["lit"][a]), tuple(t["exact"][a:a + size]), None) for a in range(len(t["exact"]) - size + 1)]


def brute(rows, items):
    """Windows of two texts compared one by one, along every alignment."""
    out = set()
    for i, text in rows:
        for k, item in items:
            size = min(len(D.template(item)["exact"]), D.WINDOW)
            if not size:
                continue
            own, lines = cut(item, size), {}
            for p, lit, words, slots in cut(text, size):
                for q, at, others, values in own:
                    if words == others and (slots is None) == (values is None):
                        lines.setdefault(lit - at, set()).add((q, None if slots is None else tuple(zip(values, slots))))
            hit, run = set(), False
            for line in lines.values():
                pairs = Counter(f for _, fs in line if fs is not None for f in fs)
                best = {v: max((n, d == v, d if d < 2 ** 63 else d - 2 ** 64) for (w, d), n in pairs.items() if w == v)[2] for v, _ in pairs}
                at = {q for q, fs in line if fs is None or all(best[v] % 2 ** 64 == d for v, d in fs)}
                hit |= at
                run |= D.RUN > size and any(all(b + j in at for j in range(D.RUN - size + 1)) for b in at)
            typed, places = {p for p, _, _, v in own if v is not None}, {p for p, *_ in own}
            if run or len(hit) >= D.LEAST * len(places) or typed and len(hit & typed) >= D.LEAST * len(typed):
                out.add((i, k))
    return out


def test_same_question_with_other_values(spark):
    rng = random.Random(0)
    docs = [row(1, prose(rng, 40) + "\n" + ITEM + "\n" + prose(rng, 20)), row(2, prose(rng, 30) + "\n" + OTHER), row(3, MIXED), row(4, prose(rng, 200)), row(5, ITEM.upper()), row(6, "Nice: water over garden stones, he said")]
    got = found(spark, frame(spark, docs))
    assert {(1, 0), (2, 0), (6, 5)} <= set(got) and not any(d == 4 for d, _ in got)
    assert got[3, 0].coverage < 1  # the windows of Joe and 41, or of Bob and 40, are dropped
    assert got[1, 0].changed == 0 and got[2, 0].changed > 0 and got[1, 0].coverage == 1.0
    assert set(got) == brute([(d[0], d[1]) for d in docs], ITEMS)


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(6, 40))) for k in range(8)]
    rows = corpus(2, 20)
    for k in range(12):
        words = items[k % 8][1].split(" ")
        cut = " ".join(words[rng.randint(0, 4):len(words) - rng.randint(0, 12)])
        rows.append(row(300 + k, prose(rng, 15) + " " + cut + " " + prose(rng, 15)))
    assert set(found(spark, frame(spark, rows), items)) == brute([(r[0], r[1]) for r in rows], items)


def test_unbounded_benchmark_takes_the_shuffled_join(spark, monkeypatch):
    docs = frame(spark, [row(1, ITEM), row(2, OTHER), row(3, MIXED)])
    want = set(found(spark, docs))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert set(found(spark, docs)) == want == {(1, 0), (2, 0), (3, 0)}


def test_awkward_tables(spark):
    rows = [row(1, ITEM), row(1, ITEM), row(2, None), row(3, ""), row(None, ITEM)]
    assert set(found(spark, clashing(frame(spark, rows)))) == {(1, 0), (None, 0)}
    assert not found(spark, frame(spark, [])) and not found(spark, frame(spark, rows), [(1, None)])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contaminated(frame(spark, rows), bench).count() == 0


def test_verbatim_items_dense_in_values(spark):
    items = [(0, "What is 12 + 7 * 3?"), (1, "Compute 12 times 7"), (2, "The Old Man And The Sea By Ernest Hemingway"),
             (3, "Add 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 to the given list of the numbers here")]
    run = " ".join(map(str, range(1, 15)))
    docs = [row(1, "He asked: what is 12 + 7 * 3? Nobody knew."), row(2, "Please compute 12 times 7 now"), row(3, "Yesterday we read The Old Man And The Sea By Ernest Hemingway aloud"),
            row(4, f"count {run} and stop"), row(5, "What is 13 + 8 * 4? Compute 13 times 8"), row(6, "count 1 2 3 4 5 6 7 8 9 and stop")]
    assert set(found(spark, frame(spark, docs), items)) == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_verbatim_windows_count_beside_a_conflicting_slot(spark):
    item = "they take 12 of the stones from under the old garden wall and carry them over to the new house where 12 men wait"
    docs = [row(1, item[::-1].replace("21", "31", 1)[::-1]), row(2, item), row(3, "they take 15 of the stones and 16 men wait")]
    assert docs[0][1].endswith("where 13 men wait")
    got = found(spark, frame(spark, docs), [(0, item)])
    assert set(got) == {(1, 0), (2, 0)} and got[2, 0].changed == 0


def test_a_slot_may_be_several_words(spark):
    docs = [row(1, OTHER.replace("Bob", "Mary Jane")), row(2, OTHER.replace("40", "forty")), row(3, OTHER.replace("$9", "9 dollars")),
            row(4, ITEM.replace("12 pears", "13 pears")), row(5, ITEM.replace("Anna", "Bill").replace("apples", "stones").replace("pears", "boats").replace("lunch", "rain").replace("buys", "sells"))]
    got = found(spark, frame(spark, docs), [(0, ITEM)])
    assert set(got) == {(k, 0) for k in (1, 2, 3, 4)} == brute([(d[0], d[1]) for d in docs], [(0, ITEM)])


def test_a_list_of_names_is_found_word_for_word(spark):
    names = "Anna Bob Carl Dora Emil Frida Gustav Helga Ivan Judith Karl Lena Moritz"
    docs = [row(1, "they were " + names + " and others"), row(2, "they were Anna Bob Carl and others")]
    assert set(found(spark, frame(spark, docs), [(0, names)])) == {(1, 0)}


def test_documents_are_told_apart_by_id_and_text(spark):
    half = ITEM.split(". ")
    docs = [row(None, half[0]), row(None, half[1]), row(None, "clean words stand here"), row(7, ITEM), row(7, "clean")]
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    r = D.find_contaminated(frame(spark, docs), bench).collect()
    assert [(x.doc_id, x.item_id) for x in r] == [(7, 0)]
    from labelq.llm.common import without

    left = without(frame(spark, docs), D.find_contaminated(frame(spark, docs), bench).select("doc_id", "key")).collect()
    assert sorted(x.text for x in left) == sorted(d[1] for d in docs if d[1] != ITEM)


def test_slots_without_consistency_are_not_the_item(spark):
    item = "then Tom gave me 12 red stones and Tom took 12 blue ones so Tom sold 12 green pots and Tom has 12 more now"
    same = item.replace("Tom", "Bob").replace("12", "7")
    mixed = item
    for name, number in (("Ann", "3"), ("Bob", "4"), ("Carl", "5"), ("Dora", "6")):
        mixed = mixed.replace("Tom", name, 1).replace("12", number, 1)
    got = set(found(spark, frame(spark, [row(1, same), row(2, mixed), row(3, item)]), [(0, item)]))
    assert got == {(1, 0), (3, 0)} == brute([(1, same), (2, mixed), (3, item)], [(0, item)])
