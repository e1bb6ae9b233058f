"""Helpers that test modules import; fixtures stay in conftest.py."""


def sorted_rows(df, *columns):
    """Sorted tuples, for order-free comparison."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
