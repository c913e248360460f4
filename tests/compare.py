"""Compare registered queries with their SQL: python -m tests.compare [sf] [name ...]"""
import math, sys, time
import duckdb
from blendspark.plans import ORACLES, QUERIES
from blendspark.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for name in names:
        try:
            t0 = time.time()
            df = QUERIES[name](spark, folder)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in ORACLES:
                print(f"rows {name}: {len(rows)} {t1-t0:.1f}s {rows[:1]}", flush=True)
                continue
            rel = con.execute(ORACLES[name])
            ocols = [d[0] for d in rel.description]
            orows = rel.fetchall()
            t2 = time.time()
            order, oorder = sorted(range(len(cols)), key=lambda i: cols[i]), sorted(range(len(ocols)), key=lambda i: ocols[i])
            a = sorted(tuple(canon(r[i]) for i in order) for r in rows)
            b = sorted(tuple(canon(r[i]) for i in oorder) for r in orows)
            types = {c: (t, str(rel_t[1])) for (c, t), rel_t in zip(sorted(df.dtypes), sorted(((d[0], d[1]) for d in con.description)))}
            ok = sorted(cols) == sorted(ocols) and a == b
            tn = " ".join(f"{c}:{x}/{y}" for c, (x, y) in types.items())
            print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(rows)}/{len(orows)} spark {t1-t0:.1f}s sql {t2-t1:.1f}s {'' if ok and len(a) else tn}", flush=True)
            if not ok:
                bad.append(name)
                in_a, in_b = set(a), set(b)
                print("   only spark", [x for x in a if x not in in_b][:3])
                print("   only sql  ", [x for x in b if x not in in_a][:3])
        except Exception as e:
            bad.append(name)
            print("FAIL", name, str(e)[:1500], flush=True)
    print("bad:", bad)


main()
