"""Times the headline operators and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. The lap tables are landed as Parquet first and not timed. Every
operator runs once to warm up and is then timed over a full materialisation of its result.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from lapreplay import fixtures  # noqa: E402
from lapreplay.operators import clean, corpus, dataset, profile, replay, validate  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def landed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The lap tables and the dataset made of them, as files."""
    out = {}

    def land(name: str, df: DataFrame) -> None:
        df.write.parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")

    for make in (fixtures.laps, fixtures.laps_raw, fixtures.laps_big, fixtures.results, fixtures.sessions):
        land(make.__name__, make(spark, SF_DIR))
    land("dataset", dataset.build_race_dataset(out["laps"], out["results"], out["sessions"], check=False))
    return out


def headline(t: dict[str, DataFrame]) -> dict:
    return {
        "build_race_replay": lambda: replay.build_race_replay(t["laps"], check=False),
        "build_race_replay_checked": lambda: replay.build_race_replay(t["laps"]),
        "build_race_replay_big": lambda: replay.build_race_replay(t["laps_big"], check=False),
        "validate_laps": lambda: validate.validate_laps(t["laps_raw"]),
        "clean_columns": lambda: clean.clean_columns(t["laps_raw"]),
        "build_race_dataset": lambda: dataset.build_race_dataset(t["laps"], t["results"], t["sessions"], check=False),
        "build_race_dataset_checked": lambda: dataset.build_race_dataset(t["laps"], t["results"], t["sessions"]),
        "check_dataset": lambda: dataset.check_dataset(t["dataset"]),
        "corpus_summary": lambda: corpus.corpus_summary(t["dataset"]),
        "chronological_split": lambda: corpus.chronological_split(t["dataset"], 2023, 5, (2024,), check=False),
        "table_profile": lambda: profile.table_profile(t["laps_raw"], "laps"),
    }


def main() -> None:
    seconds = {}
    with tempfile.TemporaryDirectory(prefix="lapreplay-bench-") as root:
        spark = (
            SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.checkpoint.dir", f"file://{root}/shared")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        for name, query in headline(landed(spark, f"file://{root}")).items():
            for _ in range(2):
                began = time.perf_counter()
                query().write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.perf_counter() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline operators on landed tables, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
