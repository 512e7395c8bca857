"""Comparison of frames."""


def rows(pdf):
    """Rows of a frame in an order of their own, values as text."""
    cols = sorted(pdf.columns)
    text = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(text(v) for v in r) for r in pdf[cols].itertuples(index=False))
