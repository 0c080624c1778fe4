"""Raw trip records with faults, and tables that are read by month."""

from curbside.schemas import RAW_TRIPS
from curbside.sources import tables


def test_bad_records_are_counted_and_months_pruned(spark, tmp_path):
    names = tables.trip_columns()
    assert names[:3] == ["PULocationID", "DOLocationID", "request_datetime"] and len(names) == len(RAW_TRIPS.split(", "))
    good = {"PULocationID": "3", "DOLocationID": "4", "request_datetime": "2026-01-05T08:00:00", "trip_miles": "2.5", "trip_time": "600"}
    faults = [{}, {"request_datetime": "2026-02-01T00:00:00"}, {"trip_miles": "far"}, {"PULocationID": ""}, {"request_datetime": "soon"}, {"trip_miles": ""}]
    lines = [",".join(names)] + [",".join((good | f).get(c, "") for c in names) for f in faults]
    (tmp_path / "trips.csv").write_text("\n".join(lines) + "\n")
    kept, bad = tables.stage_trips(tables.scan_trips(spark, str(tmp_path)))
    assert bad == 3 and kept.count() == 3
    assert sorted(str(r.request_month) for r in kept.collect()) == ["2026-01-01", "2026-01-01", "2026-02-01"]
    plan = kept.where("request_month = DATE'2026-02-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(request_month" in plan


def test_compressed_text_reads_as_plain_text_and_takes_a_fraction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_FILE", 400)
    trips = spark.range(0, 1500, 1, 1).selectExpr(
        "CAST(1 + id % 9 AS INT) AS PULocationID", "CAST(1 + id % 7 AS INT) AS DOLocationID",
        "TIMESTAMP_NTZ'2026-01-05 08:00:00' + make_dt_interval(id % 50) AS request_datetime", "'N' AS shared_request_flag",
    )
    names = tables.trip_columns()
    trips = trips.selectExpr(*[c if c in trips.columns else f"CAST(NULL AS STRING) AS {c}" for c in names])
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    tables.write_csv(trips, str(plain))
    tables.write_csv(trips, str(packed), compression="gzip")
    files = list(packed.glob("*.csv.gz"))
    assert len(files) == 4 and 3 * sum(f.stat().st_size for f in files) < sum(f.stat().st_size for f in plain.glob("*.csv"))
    one, two = (tables.stage_trips(tables.scan_trips(spark, str(p))) for p in (plain, packed))
    assert one[1] == two[1] == 0 and two[0].count() == 1500 and one[0].exceptAll(two[0]).isEmpty()
    assert all(".zstd." in f for f in two[0].inputFiles())
