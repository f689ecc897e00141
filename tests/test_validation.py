from __future__ import annotations

from tripweave.operators import validation
from tripweave.sources import records, tables

ROW = "YEAR int, MONTH int, FL_DATE date, OP_UNIQUE_CARRIER string, TAIL_NUM string, OP_CARRIER_FL_NUM int, ORIGIN_AIRPORT_ID int, ORIGIN string, DEST string, DEP_TIME double, DEP_DELAY double, ARR_TIME double, ARR_DELAY double, CANCELLED double, AIR_TIME double, FLIGHTS double, DISTANCE double"


def test_schema(spark, sf_dir):
    assert validation.schema_errors(tables.trips(spark, sf_dir)) == []
    assert len(validation.schema_errors(spark.createDataFrame([(2024, 1)], "YEAR int, MONTH int"))) == 15
    assert validation.schema_errors(spark.createDataFrame([], ROW.replace("DISTANCE double", "DISTANCE string"))) == ["column DISTANCE is string, expected one of float, double"]


def test_constraints(spark):
    rows = [(2024, 1, None, "AA", None, 1, 1, "JFK", "LAX", 1.0, -5.0, 1.0, 2.0, 0.0, 3.0, 1.0, 9.0), (2024, 13, None, None, "N1", 1, 1, "", "LAX", None, 7.0, 1.0, 2.0, 1.0, None, 1.0, 9.0), (2023, 6, None, "AA", "N1", 1, 1, "JFK", "LAX", 1.0, None, 1.0, 2.0, 0.0, 3.0, 1.0, 9.0)]
    row = validation.constraint_metrics(spark.createDataFrame(rows, ROW), 2024).first()
    assert (row.total_rows, row.year_matches, row.month_valid, row.n_cancelled, row.tail_num_nulls, row.dep_delay_min, row.dep_delay_max) == (3, 2, 2, 1.0, 1, -5.0, 7.0)
    assert row.n_unique_carriers == 2 and row.origin_non_empty == 2
    assert abs(row.month_invalid_pct - 100 / 3) < 1e-9
    assert validation.constraint_metrics(spark.createDataFrame([], ROW), 2024).first().month_invalid_pct == 0


def test_air_time_logic(spark):
    df = spark.createDataFrame([(0.0, 180.0), (0.0, None), (1.0, None), (1.0, 150.0)], "CANCELLED double, AIR_TIME double")
    row = validation.air_time_logic(df).first()
    assert (row.n_cancelled, row.n_not_cancelled, row.cancelled_airtime_null, row.active_airtime_positive) == (2, 2, 1, 1)
    assert validation.air_time_logic(df.limit(0)).first().cancelled_airtime_null_pct is None


def test_sources(spark, tmp_path):
    import pytest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.csv").write_text("YEAR,MONTH,FL_DATE,OP_UNIQUE_CARRIER,CANCELLED\n2024,2,2/1/2024 12:00:00 AM,AA,0\n")
    (folder / "a.csv").write_text("YEAR,MONTH,FL_DATE,OP_UNIQUE_CARRIER,CANCELLED,TAIL_NUM\n2024,1,1/1/2024 12:00:00 AM,DL,1,N1\n2023,1,1/1/2023 12:00:00 AM,DL,0,N1\n")
    assert [p.rsplit("/", 1)[1] for p in records.monthly_files(spark, str(folder))] == ["a.csv", "b.csv"]
    made = records.prepared(records.read_monthly(spark, str(folder)))
    assert tuple(made.columns) == records.COLUMNS and made.filter("TAIL_NUM is null").count() == 1
    out = str(tmp_path / "out")
    records.write(made, out)
    records.write(made.limit(0), out)  # stays as it is
    assert records.load(spark, out, 2024).count() == 1 and records.load(spark, out, 2024, True, ("DL",)).count() == 1
    records.write(made.limit(0), out, overwrite=True)
    assert records.load(spark, out).count() == 0
    with pytest.raises(ValueError):
        records.scan(spark, out, "avro")


def test_config():
    import pytest

    from tripweave.config import Config

    made = Config.of({"seed": 7, "edges": {"route_knn_k": 2}, "filters": {"carriers": ["AA"]}})
    assert (made.seed, made.edges.route_knn_k, made.edges.include_tail_sequence, made.filters.carriers) == (7, 2, True, ("AA",))
    with pytest.raises(ValueError):
        Config.of({"sed": 1})


def test_manifest(tmp_path, spark):
    from tripweave.sources import manifests

    (tmp_path / "x").write_text("abc")
    made = manifests.run_manifest(spark, "build", [str(tmp_path / "x"), str(tmp_path / "none")], {"a": 1}, str(tmp_path / "m.json"))
    assert [o["bytes"] for o in made["outputs"]] == [3] and (tmp_path / "m.json").exists()
    assert manifests.done_already(spark, [str(tmp_path / "x")], False) and not manifests.done_already(spark, [str(tmp_path / "none")], False)
    a, b = spark.createDataFrame([], "a int, b int"), spark.createDataFrame([], "b int, a int")
    assert manifests.schema_hash(a) == manifests.schema_hash(b) and len(manifests.schema_hash(a)) == 16
