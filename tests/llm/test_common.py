import numpy as np
import pytest
from data import frame, row

from labelq.llm import common as C


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    g = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in g.integers(-30, 30, (25, 2))] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 220)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent if v in {x for e in edges if e[0] != e[1] for x in e}}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_goes_by_id_and_text(spark):
    docs = frame(spark, [row(1, "a"), row(2, "b"), row(None, "c"), row(2, "d"), row(None, "e"), row(3, None), row(3, "")])
    gone = docs.where("text in ('b', 'e') or text is null").select("doc_id", C.text_key("text"))
    assert sorted(r.text for r in C.without(docs, gone.union(gone)).collect()) == ["", "a", "c", "d"]


def test_repeated_rows_are_kept_once(spark):
    docs = frame(spark, [row(1, "a")] * 3 + [row(1, "b")] * 2 + [row(None, "a")] * 2 + [row(2, None)] * 2)
    one = docs.where("text = 'a' or text is null").select("doc_id", C.text_key("text"))
    got = sorted((r.doc_id or 0, r.text or "") for r in C.only_first(docs, one).collect())
    assert got == [(0, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "")]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, k, v):
            raise AssertionError("no folder may be made up")

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn", "k8s://host"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError):
            C.shared_dir(Session)


def test_written_tables_can_be_deleted(spark):
    df = C.materialise(spark.range(3).toDF("x"))
    path = C._WRITTEN[-1]
    assert df.count() == 3 and path.startswith("file:")
    other = C.materialise(spark.range(2).toDF("x"))
    C.discard(other)
    assert path in C._WRITTEN and len(C._WRITTEN) > 0 and other._labelq_path not in C._WRITTEN
    C.clean(spark)
    p, fs = C._hadoop(spark, path)
    assert not fs.exists(p) and not C._WRITTEN
