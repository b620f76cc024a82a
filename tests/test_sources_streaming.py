"""Readers, writers and streams over small folders."""

import datetime

from pyspark.sql import functions as F

from terazi.sources import files, sinks
from terazi.streaming import flows


def test_text_files_with_either_encoding(spark, tmp_path):
    (tmp_path / "alt").mkdir()
    (tmp_path / "a.txt").write_bytes("Çığ düştü, İş".encode())
    (tmp_path / "alt/b.txt").write_bytes("Çığ düştü, İş “x”".encode("cp1254"))
    (tmp_path / "c.txt").write_bytes(b"   ")
    (tmp_path / "d.bin").write_bytes(b"no")
    got = {r.belge: r.metin for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Çığ düştü, İş", "b.txt": "Çığ düştü, İş “x”"}


def test_real_documents(spark, tmp_path):
    for name, n in (("a.pdf", 5000), ("b.pdf", 100), ("c.pdf", 7777)):
        (tmp_path / name).write_bytes(b"x" * n)
    assert [r.belge for r in files.real_documents(spark, str(tmp_path), (7777,)).collect()] == ["a.pdf"]


def test_records_and_dead_letters(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"kaynak": "1-1", "hedef": "1-2", "iliski": "atif"}, {"kaynak": "1-3"}]')
    (tmp_path / "b.json").write_text("{bozuk")
    got = files.records(spark, str(tmp_path), "kenar").cache()
    assert got.filter("kaynak is not null").count() == 2
    assert sinks.dead_letters(got, "kenar").count() == 1


def test_replace_and_merge(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_table(spark.range(3).toDF("k"), path)
    old = spark.read.parquet(path)
    merged = sinks.merge_by_key(old.withColumn("v", F.lit(0)), spark.createDataFrame([(2, 1), (9, 1)], "k long, v int"), "k", F.desc("v"))
    assert sorted((r.k, r.v) for r in merged.collect()) == [(0, 0), (1, 0), (2, 1), (9, 1)]
    sinks.replace_table(spark.range(1).toDF("k"), path)
    assert spark.read.parquet(path).count() == 1


def _stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_daily_spending(spark, tmp_path):
    day = datetime.datetime
    stream = _stream(spark, tmp_path, [(day(2024, 1, 1, 5), 1.0), (day(2024, 1, 1, 9), 2.0), (day(2024, 1, 2, 1), 4.0)], "ts timestamp_ntz, value double")
    got = flows.run_once(flows.daily_spending(stream), "harcama", str(tmp_path / "cp"), "complete")
    assert sorted((r.gun.day, r.istek, r.tutar) for r in got.collect()) == [(1, 2, 3.0), (2, 1, 4.0)]


def test_accumulate_skips_known(spark, tmp_path):
    out = str(tmp_path / "out")
    stream = _stream(spark, tmp_path, [("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    flows.accumulate(stream, out, "id", str(tmp_path / "cp")).awaitTermination()
    _stream(spark, tmp_path, [("b", 2), ("c", 3)], "id string, v int")
    flows.accumulate(stream, out, "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_first_seen(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    stream = _stream(spark, tmp_path, [("a", t), ("a", t), ("b", t)], "id string, t timestamp_ntz")
    got = flows.run_once(flows.first_seen(stream, "id", "t"), "ilkler", str(tmp_path / "cp"))
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_metric_log(spark, tmp_path):
    stream = _stream(spark, tmp_path, [("soru", 0.5)], "soru string, sure double")
    flows.append_metrics(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_sessions_end_after_the_gap(spark, tmp_path):
    t = datetime.datetime
    rows = [(1, t(2024, 1, 1, 5, 0)), (1, t(2024, 1, 1, 5, 30)), (1, t(2024, 1, 1, 9, 0)), (2, t(2024, 1, 3, 1, 0))]
    stream = _stream(spark, tmp_path, rows, "oturum long, ts timestamp_ntz")
    got = flows.run_once(flows.sessions(stream, "oturum"), "oturumlar", str(tmp_path / "cp"))
    assert sorted((r.oturum, r.bas.hour, r.son.hour, r.n) for r in got.collect()) == [(1, 5, 5, 2), (1, 9, 9, 1)]
