import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import logs as lg
from tidemark.sources import tables as tb
from tidemark.workspace import new_path


def write(path, name, text):
    (path / name).write_text(text)


def test_folder_with_differing_headers(spark, tmp_path):
    write(tmp_path, "b_day.csv", " x , Label\n1,BENIGN\n2,Bot\n")
    write(tmp_path, "a_day.csv", "Label,x, extra\nDDoS,3,9\n")
    write(tmp_path, "c_day.csv", " x , Label\n4,BENIGN\n")
    write(tmp_path, "note.txt", "nothing")
    df = tb.scan_csv_folder(spark, str(tmp_path), "x long, Label string, extra int")
    assert sorted((r["x"], r["Label"], r["extra"]) for r in df.fillna(0).collect()) == [(1, "BENIGN", 0), (2, "Bot", 0), (3, "DDoS", 9), (4, "BENIGN", 0)]
    assert tb.scan_csv_folder(spark, str(tmp_path), name_part="a_").count() == 1
    assert dict(tb.scan_csv_folder(spark, str(tmp_path)).dtypes)["x"] == "int"
    with pytest.raises(FileNotFoundError):
        tb.scan_csv_folder(spark, str(tmp_path), name_part="zzz")


def test_named_datasets(spark, tmp_path):
    write(tmp_path, "u.csv", "dur,spkts,label\n1.5,3,0\n2.5,4,1\n")
    got = tb.load_dataset(spark, str(tmp_path), "unsw_nb15").orderBy("`Flow Duration`").collect()
    assert [(r["Flow Duration"], r["Total Fwd Packets"], r["Label"], r["_original_label"]) for r in got] == [(1.5, 3, "BENIGN", "0"), (2.5, 4, "ATTACK", "1")]
    with pytest.raises(ValueError):
        tb.load_dataset(spark, str(tmp_path), "nothing")


def test_headerless_labels_and_categories(spark, tmp_path):
    write(tmp_path, "h.csv", "1.0, Exploits ,1\n2.0,,x\n3.0,Fuzzers,\n")
    df = tb.scan_headerless(spark, str(tmp_path / "h.csv"), "v double, cat string, label int", "label", "cat")
    assert sorted(tuple(r) for r in df.collect()) == [(1.0, "Exploits", 1), (2.0, "Normal", 0), (3.0, "Fuzzers", 0)]


def test_samples_repeat_whatever_the_partitioning(spark):
    df = spark.range(1000)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(tb.sample_n(df, 50, ["id"])) == ids(tb.sample_n(df.repartition(7), 50, ["id"]))
    assert 150 < tb.sample_fraction(df, 0.2, ["id"]).count() < 250
    assert ids(tb.row_cap(df.repartition(5), 3, ["id"])) == [0, 1, 2]
    large = tb.row_cap(spark.range(150_000), tb.TOP_K_ROWS + 1, ["id"])
    assert large.count() == tb.TOP_K_ROWS + 1 and large.agg(F.max("id")).first()[0] == tb.TOP_K_ROWS


def test_logs_replace_repeated_batches(spark):
    day = datetime.datetime(2024, 5, 1, 12)
    rows = [(i, day + datetime.timedelta(hours=i), "ATTACK" if i % 2 else "BENIGN", 0.5 + i / 20) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, y_pred string, confidence double")
    root = new_path(spark, "test-logs")
    for number in (0, 1, 1):
        lg.append(lg.attack_records(df.withColumn("id", F.col("id") + 100 * number), "ts", "y_pred", "confidence", id="id"), root, "attacks", number)
    log = lg.read(spark, root, "attacks")
    assert log.count() == 10 and log.filter("severity = 'high'").count() == 2 and log.filter("severity = 'low'").count() == 4
    assert [r["id"] for r in lg.recent(log, 3, ["id"]).collect()] == [109, 9, 107]
    s = lg.statistics({"predictions": df, "attacks": log}).first()
    assert (s["total_predictions"], s["total_attacks"], s["unacknowledged_attacks"]) == (10, 10, 10)


def test_result_sinks(spark):
    df = spark.createDataFrame([(1, {"a": 1.5})], "id int, state map<string,double>")
    path = new_path(spark, "sink")
    lg.write_result(df, f"{path}/csv", "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv").first()["state"] == '{"a":1.5}'
    lg.write_result(df, f"{path}/json", "json")
    assert spark.read.schema(df.schema).json(f"{path}/json").first()["state"] == {"a": 1.5}
    with pytest.raises(ValueError):
        lg.write_result(df, path, "xls")


def test_drift_and_retrain_logs(spark):
    now = datetime.datetime(2024, 1, 2)
    root = new_path(spark, "test-drift-log")
    drifts = spark.createDataFrame([(now, "adwin", 383, {"n_drifts": 1.0})], "ts timestamp, detector string, pos long, state map<string,double>")
    lg.append(lg.drift_records(drifts, "ts", "detector", "pos", "state"), root, "drift_events", 0)
    retrains = spark.createDataFrame([(now, "v2", "drift", 20000, 1.23456)], "ts timestamp, version string, trigger string, n long, s double")
    lg.append(lg.retrain_records(retrains, "ts", "version", "trigger", "n", "s"), root, "model_log", 0)
    assert lg.read(spark, root, "drift_events").first()["detector_state"] == {"n_drifts": 1.0}
    assert lg.read(spark, root, "model_log").first()["training_time_s"] == 1.235
    s = lg.statistics({n: lg.read(spark, root, n) for n in ("drift_events", "model_log")}).first()
    assert (s["total_drift_events"], s["total_model_log"], s["unacknowledged_attacks"]) == (1, 1, 0)
