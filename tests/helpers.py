"""Helpers of the tests."""

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def same_rows(df, duck, sql):
    """Column names and multisets of rows of a Spark result and a DuckDB query agree."""
    cols = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
