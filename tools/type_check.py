"""Compare result column types of each Spark query and its DuckDB oracle."""
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
import duckdb  # noqa: E402

from tablescope.plans import TABLES, oracle_sql, queries  # noqa: E402
from tablescope.session import local_session  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def main():
    sf = "/root/testdata/sf0.001"
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = queries(), oracle_sql()
    names = sys.argv[1:] or sorted(orc)
    for name in names:
        try:
            s = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in qs[name](spark, sf).schema.fields}
            rel = con.sql(orc[name])
            d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        except Exception as e:  # noqa: BLE001
            print("ERR", name, str(e)[:150])
            continue
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff:
            print(name, diff)


if __name__ == "__main__":
    main()
