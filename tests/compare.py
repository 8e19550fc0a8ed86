"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb


def connect(folder: str):
    from bunkerline.sources.views import BASE_TABLES

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) if not isinstance(x, (list, dict)) else (False, "l", str(x)) for x in t))


def close(a, b):
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return False


def compare(spark_df, con, sql):
    rows = [tuple(r) for r in spark_df.collect()]
    cols = spark_df.columns
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    otypes = [str(d[1]) for d in cur.description]
    orows = cur.fetchall()
    c1, r1 = canonical(rows, cols)
    c2, r2 = canonical(orows, ocols)
    if c1 != c2:
        return "COLUMNS", f"spark={c1} oracle={c2}", len(rows)
    if len(r1) != len(r2):
        return "ROWS", f"spark={len(r1)} oracle={len(r2)}; first {r1[:1]} / {r2[:1]}", len(rows)
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    types = {c: (t.simpleString()) for c, t in zip(cols, [f.dataType for f in spark_df.schema.fields])}
    tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odict = dict(zip(ocols, otypes))
    odd = [f"{c}:{t}/{odict[c]}" for c, t in types.items() if tmap.get(t) != odict[c] and not (t == 'string' and odict[c] == 'STRING')]
    note = f" types {odd}" if odd else ""
    if bad:
        far = [(a, b) for a, b in bad if not all(close(x, y) for x, y in zip(a, b))]
        kind = "VALUES" if far else "DIGITS"
        a, b = (far or bad)[0]
        diff = [(c, x, y) for c, x, y in zip(c1, a, b) if x != y]
        return kind, f"{len(far)} far / {len(bad)} differ of {len(r1)}: {diff[:6]} key={a[:3]}{note}", len(rows)
    return "OK" if not odd else "TYPES", note, len(rows)


def main(argv):
    import __spark_entry__ as entry
    from bunkerline.session import local_session

    folder = argv[0]
    wanted = argv[1:]
    part, parts = (int(x) for x in os.environ.get("SHARD", "0/1").split("/"))
    spark = local_session(os.environ.get("CORES", "8"), os.environ.get("MEM", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for at, (name, build) in enumerate(queries.items()):
        if at % parts != part:
            continue
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                status, note, n = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                status, note = "rows-only", ""
        except Exception as exc:  # report and go on
            status, note, n = "ERROR", f"{type(exc).__name__}: {str(exc)[:900]}", -1
        failures += status not in ("OK", "rows-only")
        print(f"{status:9s} {name:32s} rows={n:<7d} {time.time() - t0:6.2f}s {note}", flush=True)
    print("not ok:", failures)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1:])
