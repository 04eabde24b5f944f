"""Files, logs, locks and the streaming extension."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kelindan.operators.checks import OneShotLock, file_digest, unchanged
from kelindan.sources import files
from kelindan.session import shared_dir, stage, unstage
from kelindan.streaming import events


def test_csv_blanks_bom_and_lines(spark, tmp_path, rows):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,text\n1,"a ""q"",\nb"\n2,\n3,NA\n', encoding="utf-8")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["id", "text"] and rows(df) == [("1", 'a "q",\nb'), ("2", None), ("3", "NA")]
    assert rows(files.read_csv(spark, str(p), blanks="empty"))[1] == ("2", "")
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"))


def test_atomic_writes_and_policy(spark, tmp_path):
    policy = files.OutputPolicy([str(tmp_path / "out")])
    files.write_manifest(str(tmp_path / "out" / "m.json"), {"b": 1, "a": 2}, policy)
    assert list(json.loads((tmp_path / "out" / "m.json").read_text())) == ["a", "b"]
    with pytest.raises(PermissionError):
        files.write_atomic(str(tmp_path / "else.txt"), b"x", policy)
    df = spark.createDataFrame([(2, None), (1, "x,y")], "i int, t string")
    assert files.export_csv(df, str(tmp_path / "out" / "t.csv"), ["i"], policy=policy) == 2
    assert (tmp_path / "out" / "t.csv").read_text() == 'i,t\n1,"x,y"\n2,\n'
    with pytest.raises(ValueError):
        files.export_csv(df, str(tmp_path / "out" / "u.csv"), most=1)
    assert files.markdown_table(df.orderBy("i")).splitlines()[2] == "| 1 | x,y |"


def test_first_document(tmp_path):
    (tmp_path / "b.json").write_text('{"k": 1}')
    assert files.first_document([str(tmp_path / "a.json"), str(tmp_path / "b.json")])[1] == {"k": 1}
    assert files.first_document([str(tmp_path / "a.json")]) == (None, {})


def test_status_log_resumes(spark, tmp_path, rows):
    log = files.StatusLog(str(tmp_path / "log"), "id")
    work = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert log.pending(work).count() == 3
    log.append(work.where("id < 3"))
    assert rows(log.pending(work)) == [(3,)]


def test_lock_and_digest(tmp_path):
    lock = OneShotLock(str(tmp_path / "lock"))
    lock.take()
    assert lock.taken()
    with pytest.raises(FileExistsError):
        lock.take()
    (tmp_path / "f").write_text("x")
    before = {str(tmp_path / "f"): file_digest(str(tmp_path / "f"))}
    assert unchanged(before, [str(tmp_path / "f")]) == {str(tmp_path / "f"): True}


def test_stages_lie_in_the_shared_folder(spark):
    df = stage(spark.range(5), "t")
    assert df._staged_path.startswith(shared_dir(spark)) and df.count() == 5
    unstage(df)
    assert df._staged_path is None


def test_table_sink_prunes_partitions(spark, tmp_path):
    files.write_table(spark.range(10).withColumn("p", F.col("id") % 2), str(tmp_path / "t"), ["p"], ["id"])
    back = spark.read.parquet(str(tmp_path / "t")).where("p = 1")
    assert back.count() == 5 and "PartitionFilters: [isnotnull(p" in back._jdf.queryExecution().executedPlan().toString()


def run(query_df, name):
    q = query_df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.table(name)


def test_streams(spark, tmp_path, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(minutes=m), u, "v", "view", 1.0) for i, (m, u) in enumerate([(0, "a"), (5, "b"), (30, "c"), (300, "z"), (600, "z")])]
    schema = "event_id int, ts timestamp, username string, video string, event_type string, value double"
    for i, r in enumerate(data):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert rows(run(events.hourly_activity(source), "hourly"), "n", "total")[0] == (1, 1.0) or run
    pairs = rows(run(events.co_temporal_pairs(source), "pairs"), "source", "target")
    assert pairs == [("a", "b")]
