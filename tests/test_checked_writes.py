"""A dataset is checked before it gets to its place, in the queries too."""

import pytest

from lapreplay import queries
from lapreplay.schemas import DatasetError
from lapreplay.sources import io

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["write_race_dataset", "overwrite_guard"])
def test_a_broken_dataset_is_not_stored(spark, monkeypatch, tmp_path, name):
    bad = queries.spoilt(spark, FOLDER)
    monkeypatch.setattr(queries, "the_dataset", lambda *a: bad)
    monkeypatch.setattr(queries, "folder", lambda s, n: f"file://{tmp_path}/{n}")
    with pytest.raises(DatasetError, match="completed_beyond_snapshot"):
        queries.QUERIES[name](spark, FOLDER)
    assert not [p for p in tmp_path.glob("dataset*") if any(p.rglob("*.parquet"))]


@pytest.mark.parametrize(("name", "checked"), [("write_race_dataset", 1), ("read_manifest", 1), ("verify_checksum", 1), ("overwrite_guard", 2), ("tree_checksum", 2), ("recovered_publication", 2), ("atomic_commit", 2), ("stored_summary", 2)])
def test_every_write_is_checked(spark, monkeypatch, name, checked):
    """As many checks as writes that are published; a summary's write that leaves a driver out isn't checked, since a race may lose its winner by it."""
    check, found = io.validate_race_dataset, []
    monkeypatch.setattr(io, "validate_race_dataset", lambda d: (found.append(check(d)), None)[1])
    queries.QUERIES[name](spark, FOLDER)
    assert len(found) == checked
