"""Column contracts and error types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RACE = ("RaceId",)

# Fixed values, down to SESSION_TYPES: the public names of columns and session types.
LAP_COLUMNS = ("Driver", "LapNumber", "LapTime", "Position", "Stint", "Compound", "TyreLife", "TrackStatus")
REPLAY_INPUT = ("Driver", "LapNumber", "Position", "Stint", "Compound", "TyreLife", "TrackStatus", "LapTimeSeconds")
METADATA = ("RaceId", "Season", "RoundNumber", "EventName", "SessionName")
REPLAY = (
    "SnapshotLap", "Driver", "Position", "CompletedLaps", "LapsBehindLeader", "Stint", "Compound", "TyreLife", "TrackStatus",
    "LastLapTimeSeconds", "CumulativeLapTimeSeconds", "IsLeader", "DataAvailableThroughLap",
)
TARGET = "WonRace"
DATASET = (*METADATA, *REPLAY, TARGET)
DATASET_KEY = ("RaceId", "SnapshotLap", "Driver")
POST_RACE = frozenset({"FinalPosition", "ClassifiedPosition", "Points", "Status", "GridPosition"})
DRIVER_NAMES = ("Abbreviation", "Driver")
SESSION_TYPES = ("R", "Q", "S", "FP1", "FP2", "FP3")

_TYPES = {
    "RaceId": T.StringType(), "Season": T.IntegerType(), "RoundNumber": T.IntegerType(), "EventName": T.StringType(), "SessionName": T.StringType(),
    "SnapshotLap": T.LongType(), "Driver": T.StringType(), "Position": T.LongType(), "CompletedLaps": T.LongType(), "LapsBehindLeader": T.LongType(),
    "Stint": T.LongType(), "Compound": T.StringType(), "TyreLife": T.DoubleType(), "TrackStatus": T.StringType(), "LastLapTimeSeconds": T.DoubleType(),
    "CumulativeLapTimeSeconds": T.DoubleType(), "IsLeader": T.BooleanType(), "DataAvailableThroughLap": T.LongType(), "WonRace": T.BooleanType(),
}
DATASET_SCHEMA = T.StructType([T.StructField(c, _TYPES[c]) for c in DATASET])


class RaceDataError(ValueError):
    """A table can't be used; the message names what is wrong."""


class LapValidationError(RaceDataError):
    """Raw laps break a rule of severity error."""


class CleaningError(RaceDataError):
    """Laps can't be cleaned."""


class ReplayError(RaceDataError):
    """No safe snapshots can be made."""


class TargetError(RaceDataError):
    """Winner labels can't be made or attached."""


class DatasetError(RaceDataError):
    """A race dataset breaks its contract."""


class CorpusError(RaceDataError):
    """Race datasets can't be one corpus."""


class ArtifactError(RaceDataError):
    """Stored artifacts can't be written or read."""


def require_columns(df: DataFrame, needed, error: type[RaceDataError], table: str = "table") -> None:
    """Raise ``error`` where a column is absent or a name is used twice."""
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise error(f"the {table} has duplicate column names: {', '.join(twice)}")
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise error(f"the {table} lacks columns: {', '.join(missing)}")


def positive_int(value, name: str, error: type[RaceDataError]) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise error(f"{name} must be a positive integer")
    return value
