"""Files, ledgers, seeds and run records."""

import pytest
from pyspark.sql import functions as F

from fieldcal.schema import READING_COLUMNS, READING_SCHEMA
from fieldcal.sources.files import (
    append_ledger,
    filter_csv_rows,
    merged_readings,
    merged_station_feed,
    parse_ledger,
    read_lines,
    read_readings,
    read_station_list,
    seed_at,
    seed_table,
    write_csv,
)
from fieldcal.sources.results import failure_log, flatten_results, layout_path, read_results
from fieldcal.plans.scoring import score_file


def test_station_list_and_merge(spark, tmp_path):
    (tmp_path / "list.csv").write_text('"Stazione","Lon","Lat","Indirizzo" \n"S1","13.7890","45.6544","x"\n')
    row = read_station_list(spark, str(tmp_path / "list.csv")).first()
    assert (row.station, row.lon, row.lat) == ("S1", 13.789, 45.6544)
    folder = tmp_path / "monthly"
    folder.mkdir()
    head = "Data,Stazione,Parametro,Valore,Unita,Validazione\n"
    (folder / "b.csv").write_text(head + '01/02/2024 00:00:00,S1,PM10,"12,5",u,v\n')
    (folder / "a.csv").write_text(head + "31/01/2024 23:00:00,S1,PM10,N/D,u,v\n")
    (folder / "note.txt").write_text("ignored")
    got = merged_station_feed(spark, str(folder)).collect()
    assert [str(r.timestamp) for r in got] == ["2024-01-31 23:00:00", "2024-02-01 00:00:00"]
    assert [r.value for r in got] == ["N/D", "12.5"]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError):
        merged_station_feed(spark, str(empty))
    filter_csv_rows(spark, str(folder / "b.csv"), str(tmp_path / "f"), "PM10")
    assert spark.read.csv(str(tmp_path / "f"), header=True).count() == 1


def test_reading_files_and_guards(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        ",".join(READING_COLUMNS) + "\n2024-01-01 10:00:01.9,13.789,45.6544,CAMO001,PM10,7.5,1,2,3\n"
        "2024-01-01 10:00:00.9,13.789,45.6544,CAMO001,PM25,bad,1,2,NaN\n"
    )
    df = merged_readings(spark, str(tmp_path / "r.csv"))
    assert df.schema == READING_SCHEMA
    first, second = df.collect()
    assert first.sensor == "PM25" and first.val is None and first.gps_alt is None and second.val == 7.5
    write_csv(df.limit(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_csv(df, str(tmp_path / "out"))
    assert read_readings(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        score_file(spark, str(tmp_path / "r.csv"), str(tmp_path / "o"), -1)


def test_score_file(spark, tmp_path):
    values = {"PM10": 10, "PM25": 6, "BM_T": 20, "BM_H": 50, "BM_P": 1000}
    lines = [f"2024-01-01 10:00:01.9,13.789,45.6544,CAMO001,{s},{v},1,2,3" for s, v in values.items()]
    (tmp_path / "r.csv").write_text(",".join(READING_COLUMNS) + "\n" + "\n".join(lines) + "\n")
    score_file(spark, str(tmp_path / "r.csv"), str(tmp_path / "scored"), 1000)
    got = read_readings(spark, str(tmp_path / "scored"))
    assert got.count() == 6 and got.where("sensor = 'PM10_SR_EN'").first().time == "2024-01-01 10:00:01"


def test_seeds_and_ledger(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("83811\n14593\n3279\n")
    seeds = seed_table(read_lines(spark, str(tmp_path / "seeds.txt")))
    assert seed_at(seeds, 2) == 14593
    for index in (0, 4):
        with pytest.raises(ValueError):
            seed_at(seeds, index)
    for line in ("a;1;b;2", "a;3;b;4"):
        append_ledger(spark.createDataFrame([(line,)], "value string"), str(tmp_path / "ledger"))
    parsed = parse_ledger(read_lines(spark, str(tmp_path / "ledger")))
    assert sorted(r.arguments["a"] for r in parsed.collect()) == ["1", "3"]


def test_results(spark, tmp_path):
    (tmp_path / "result1.json").write_text(
        """{"seed": 83811, "seed_index": 1, "selected_features": ["a"], "data": "d", "timestamps": "t", "run_id": "all",
        "execution_time_in_minutes": 0.5,
        "z1": {"mae": {"train_score": 1.0, "test_score": 2.0, "train_score_sum_cocal": 3.0, "test_score_sum_cocal": 4.0}},
        "z2": {"mae": {"train_score": 5.0, "test_score": 6.0, "train_score_sum_cocal": 7.0, "test_score_sum_cocal": 8.0}}}"""
    )
    flat = flatten_results(read_results(spark, str(tmp_path), ["z1", "z2"]), ["z1", "z2"])
    assert sorted((r.zone, r.kind, r.score) for r in flat.collect() if r.kind == "test_score") == [
        ("z1", "test_score", 2.0), ("z2", "test_score", 6.0)
    ]
    assert flat.count() == 8
    path = spark.range(1).select(
        layout_path(
            "results/", F.lit("mainzone"), F.lit("features1"), F.lit("onehot"), F.lit("robust"), F.lit("simple_0.9_5"),
            F.lit("linear"), F.lit(0.3), F.lit(40), F.lit(4), F.lit(0), F.lit(2), F.lit(0),
        ).alias("p")
    ).first().p
    assert path == "results/mainzone/features1/onehot_robust_simple_0d9_5_linear/test0d3cviter40cvfold4linscale0logscaletarget1ntrain0/"
    runs = spark.createDataFrame([("a;1", None), ("a;2", "boom")], "arguments string, error string")
    assert [r.error for r in failure_log(runs, "arguments", "error").collect()] == ["boom"]
