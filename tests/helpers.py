import math
import os


def canonical(rows):
    """Rows as sorted tuples; whole floats and integers are alike, NaN is None."""

    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v if isinstance(v, (bool, str)) or v is None else float(v) if isinstance(v, int) else str(v)

    return sorted(([one(v) for v in r] for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def duck_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def assert_same(df, sql, folder):
    cols = sorted(df.columns)
    names, rows = duck_rows(sql, folder)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert canonical([tuple(r) for r in df.select(*cols).collect()]) == canonical([[r[i] for i in at] for r in rows])
