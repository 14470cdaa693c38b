"""Reading small results in tests."""


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, v) for v in t])


def by_id(df, *columns):
    """{id: value or tuple of values}."""
    result = {}
    for r in df.select("id", *columns).collect():
        result[r[0]] = r[1] if len(columns) == 1 else tuple(r[1:])
    return result
