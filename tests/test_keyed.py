"""Tables by key: upserts, deletions and updates write the buckets they must, and nothing else."""

from pyspark.sql import functions as F

from wayframe.sources.keyed import KeyedTable

SCHEMA = "k long, v string, at long"


def rows(table, version=None):
    return sorted((r.k, r.v, r["at"]) for r in table.read(version).collect())


def table_of(spark, tmp_path, n=200, buckets=16):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets)
    written = table.upsert(spark.createDataFrame([(i, f"v{i}", 1) for i in range(n)], SCHEMA))
    assert written == list(range(buckets))
    return table


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = table_of(spark, tmp_path)
    before = table.manifest()
    touched = table.upsert(spark.createDataFrame([(3, "new", 2), (3, "old", 0), (1000, "more", 1)], SCHEMA))
    after = table.manifest()
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    got = rows(table)
    assert len(got) == 201 and (3, "new", 2) in got and (1000, "more", 1) in got
    assert rows(table, table.versions()[0]) == sorted((i, f"v{i}", 1) for i in range(200))
    files = {p.parent.name for p in (tmp_path / "t" / "data" / "batch=1").rglob("*.parquet")}
    assert files == {f"bucket={b}" for b in touched}


def test_deleted_keys_stay_away_until_a_later_row(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.delete(spark.createDataFrame([(5, 3), (6, 0), (999, 3)], "k long, at long"))
    assert {r[0] for r in rows(table)} == set(range(200)) - {5}  # the deletion of 6 is older than its row
    table.upsert(spark.createDataFrame([(5, "late", 2)], SCHEMA))
    assert 5 not in {r[0] for r in rows(table)}
    table.upsert(spark.createDataFrame([(5, "back", 4)], SCHEMA))
    assert (5, "back", 4) in rows(table)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path)
    change = spark.createDataFrame([(1, "x", 2), (7, "y", 2)], SCHEMA)
    table.upsert(change, 10)
    first, held = rows(table), table.manifest()
    table.upsert(change, 10)
    assert rows(table) == first and table.manifest() == held and table.versions() == [0, 10]
    table.upsert(spark.createDataFrame([], SCHEMA), 11)
    assert rows(table) == first and table.manifest() == held
    again = KeyedTable.open(spark, str(tmp_path / "t"))
    assert (again.keys, again.order, again.buckets) == (["k"], ["at"], 16) and rows(again) == first


def test_updates_go_by_other_columns(spark, tmp_path):
    table = table_of(spark, tmp_path)
    changes = spark.createDataFrame([("v3", "w3"), ("v4", "w4"), ("nothing", "w")], "v string, new string")
    before = table.manifest()
    touched = table.update(changes, ["v"], {"v": F.col("new")})
    assert 1 <= len(touched) <= 2 and {b for b, n in table.manifest().items() if before[b] != n} == set(touched)
    assert rows(table) == sorted((i, {3: "w3", 4: "w4"}.get(i, f"v{i}"), 1) for i in range(200))


def test_old_versions_go_with_their_files(spark, tmp_path):
    table = table_of(spark, tmp_path, buckets=4)
    for turn in range(4):
        table.upsert(spark.createDataFrame([(i, f"t{turn}", 10 + turn) for i in range(200)], SCHEMA))
    assert len(table.versions()) == 2 and {r[1] for r in rows(table)} == {"t3"}
    left = [p.name for p in (tmp_path / "t" / "data").iterdir() if list(p.rglob("*.parquet"))]
    assert sorted(left) == ["batch=3", "batch=4"]
