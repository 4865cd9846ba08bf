"""Every registered query of the library itself against its SQL."""

import pytest
from helpers import duck, same

from lapreplay import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert name in queries.SQL
    same(df, con, queries.SQL[name])


def test_flagship_rows(spark):
    assert queries.entry(spark, FOLDER).count() == 1963


def test_planted_defects(spark):
    from lapreplay import fixtures
    from lapreplay.operators.validate import validate_laps

    found = validate_laps(fixtures.laps_raw(spark, FOLDER)).groupBy("code").sum("affected_rows").collect()
    counts = {r[0]: r[1] for r in found}
    assert counts["duplicate_driver_lap_rows"] == 20
    assert counts["driver_whitespace"] == 199
    assert counts["invalid_lap_time"] == 17
    assert counts["missing_track_status"] == 26
    assert len(counts) == 17
