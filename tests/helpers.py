"""Helpers of the tests; fixtures are in conftest."""


def rows(df, *columns):
    """Sorted list of tuples of the chosen columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))
