"""The eight-lap race, and comparison with DuckDB."""

import numbers
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LAPS = "RaceId string, Driver string, LapNumber long, Position long, Stint long, Compound string, TyreLife double, TrackStatus string, LapTimeSeconds double"


def race_rows(race="2024_01_test"):
    times = {"VER": [90.0, 89.0, 88.0], "NOR": [91.0, 90.0, 89.0], "BOT": [92.0, 91.0]}
    return [(race, d, lap, place, 1, "SOFT", float(lap), "1", t) for place, (d, ts) in enumerate(times.items(), 1) for lap, t in enumerate(ts, 1)]


def laps_of(spark, rows=None):
    return spark.createDataFrame(race_rows() if rows is None else rows, LAPS)


def results_of(spark, race="2024_01_test"):
    return spark.createDataFrame([(race, "VER", 1), (race, "NOR", 2), (race, "BOT", 3)], "RaceId string, Abbreviation string, Position int")


def sessions_of(spark, race="2024_01_test", season=2024, number=1):
    return spark.createDataFrame([(race, season, number, "Test", "Race")], "RaceId string, Season int, RoundNumber int, EventName string, SessionName string")


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return repr(round(float(v), 6)) if isinstance(v, numbers.Number) else str(v)


def same(df, con, sql):
    """Compare all rows of a query with those of its SQL, columns by name."""
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = sorted(tuple(plain(r[have.index(n)]) for n in names) for r in cur.fetchall())
    assert len(got) == len(want)
    assert got == want
