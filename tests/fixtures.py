"""Small sections with a known answer, in long form."""

import numpy as np

from labelq.sources.section import Section


def section(spark, x, labels, genes=None, control=(), raw=None, coords=None, vec=None, **cells):
    """A section from a dense matrix."""
    x = np.asarray(x, float)
    genes = genes or [f"g{k}" for k in range(x.shape[1])]
    extra = sorted(cells)
    row = lambda i: (i, None if labels[i] is None else str(labels[i]), *(None if coords is None else float(c) for c in (coords[i] if coords is not None else (0, 0))), *(cells[k][i] for k in extra))
    kinds = "".join(f", {k} {'double' if isinstance(cells[k][0], (float, type(None))) else 'string'}" for k in extra)
    c = spark.createDataFrame([row(i) for i in range(len(x))], "cell_id long, label string, x double, y double" + kinds)
    g = spark.createDataFrame([(n, k, n in control) for k, n in enumerate(genes)], "gene string, gene_idx int, control boolean")
    long = lambda m: spark.createDataFrame([(int(i), genes[j], float(m[i, j])) for i, j in zip(*np.nonzero(m))], "cell_id long, gene string, value double")
    e = None if vec is None else spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(vec)], "cell_id long, vec array<double>")
    return Section(c, g, long(x), None if raw is None else long(np.asarray(raw, float)), e)


MARKERS = {"T": ["T0", "T1", "T2"], "Mal": ["M0", "M1", "M2"]}


def lineages(spark, dirty=0.0, seed=0, n=60):
    """Two lineages with three markers each; a share ``dirty`` of the cells shows both."""
    g = np.random.default_rng(seed)
    genes = [*MARKERS["T"], *MARKERS["Mal"], *(f"BG{k}" for k in range(10))]
    x = g.poisson(0.2, (n, len(genes))).astype(float)
    x[:, :6] = 0
    labels = ["T" if i % 2 == 0 else "Mal" for i in range(n)]
    for i, t in enumerate(labels):
        x[i, slice(0, 3) if t == "T" else slice(3, 6)] = 7 + g.poisson(1, 3)
        if i < dirty * n:
            x[i, :6] = 8
    return section(spark, x, labels, genes), x, labels, genes


def blobs(seed=0, k=4, per=40, d=6):
    g = np.random.default_rng(seed)
    centres = g.normal(0, 8, (k, d))
    return np.concatenate([g.normal(c, 1, (per, d)) for c in centres]), [f"T{i}" for i in range(k) for _ in range(per)]
