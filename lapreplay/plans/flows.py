"""From landed tables to stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapreplay.operators.clean import clean_laps
from lapreplay.operators.dataset import planned_dataset
from lapreplay.operators.rules import enforce
from lapreplay.operators.validate import empty_tables
from lapreplay.schemas import RaceDataError
from lapreplay.sources import io


def prepare_race_data(laps: DataFrame, sessions: DataFrame, output: str, overwrite: bool = False, fail_on_input_errors: bool = True) -> DataFrame:
    """Clean the laps of all sessions, write them and their reports below ``output``; returns the reports."""
    spark = laps.sparkSession
    io.overwrite_guard(spark, [f"{output}/laps", f"{output}/reports"], overwrite)
    enforce(empty_tables(sessions, laps), RaceDataError)
    cleaned = clean_laps(laps, fail_on_input_errors=fail_on_input_errors)
    io.write_cleaned_laps(cleaned.laps, sessions, f"{output}/laps", overwrite)
    report = io.cleaning_report(cleaned.laps, cleaned.before, cleaned.after, sessions)
    report.write.mode("overwrite" if overwrite else "errorifexists").json(f"{output}/reports")
    return spark.read.schema(report.schema).json(f"{output}/reports")


def build_and_save_race_dataset(laps: DataFrame, results: DataFrame, sessions: DataFrame, output: str, start_lap: int = 1, end_lap: int | None = None, overwrite: bool = False) -> DataFrame:
    """Clean, replay, label and identify all races, checked while they are written; returns the manifests."""
    for table in (laps, results):
        enforce(empty_tables(sessions, table), RaceDataError)
    cleaned = clean_laps(laps).laps
    dataset, checks = planned_dataset(cleaned, results, sessions, start_lap, end_lap)
    return io.write_race_dataset(dataset, output, overwrite, check=False, checks=checks)


def load_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """All stored datasets as one checked corpus."""
    from lapreplay.operators.corpus import combine_race_datasets

    return combine_race_datasets([io.read_race_dataset(spark, p, check=False) for p in paths])
