"""Readers and writers of the file inputs, streaming jobs, and session
independence."""

import os

from pyspark.sql import functions as F

from clusterlens.operators import runtime as D
from clusterlens.operators import sinkfiles as C
from clusterlens.functions.timecols import epoch_millis, epoch_seconds
from clusterlens.sources.corpus import read_lines
from clusterlens.sources.edges import read_edge_list, write_edge_list
from clusterlens.sources import eventlog as EV
from clusterlens.sources import materialize as MAT
from clusterlens.sources.eventlog import EVENT_LOG_SCHEMA, event_log_path, read_event_log
from clusterlens.sources.series import read_marks, read_series
from clusterlens.sources.sinkfiles import read_sink_files
from clusterlens.sources.spells import read_edge_spells, read_vertex_spells
from clusterlens.sources.tasks import task_table
from clusterlens.streaming import jobs as ST
from tests.conftest import SF_SMALL


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_text_reader_line_breaks(spark, tmp_dir):
    _write(tmp_dir, "a.txt", "one\r\ntwo\nthree\n")
    assert [r.value for r in read_lines(spark, tmp_dir).collect()] == ["one", "two", "three"]


def test_edge_list_round_trip(spark, tmp_dir):
    e = spark.createDataFrame([("T1", "S0"), ("T2", "n1")], "src string, dst string")
    write_edge_list(e, tmp_dir + "/edges")
    assert sorted(tuple(r) for r in read_edge_list(spark, tmp_dir + "/edges").collect()) == [("T1", "S0"), ("T2", "n1")]


def test_series_and_spell_csv(spark, tmp_dir):
    _write(tmp_dir + "/s", "cm.csv", "epoch,node,idl,used,free,buff,cach,writ,read,recv,send\n5,n1,90,1,1,1,1,0,0,2,3\n")
    _write(tmp_dir + "/m", "ev.csv", "epoch,node,event,seq\n5,global,start,1\n")
    _write(tmp_dir + "/v", "v.csv", "onset,terminus,vertex_id,name,type,info\n0,4,T1,T1,task,ANY\n")
    _write(tmp_dir + "/e", "e.csv", "onset,terminus,tail,head,type\n0,4,T1,n1,taskToNode\n")
    assert read_series(spark, tmp_dir + "/s").first().send == 3.0
    assert read_marks(spark, tmp_dir + "/m").first().event == "start"
    assert read_vertex_spells(spark, tmp_dir + "/v").first().terminus == 4
    assert read_edge_spells(spark, tmp_dir + "/e").first().type == "taskToNode"


def test_flat_sink_folder(spark, tmp_dir):
    _write(tmp_dir, "app1.0.jvm.heap.used.csv", "t,value\n10,5\n11,6\n")
    _write(tmp_dir, "app1.driver.DAGScheduler.stage.x.csv", "t,value\n10,1\n")
    _write(tmp_dir, "notes.txt", "t,value\n10,1\n")
    lines = read_sink_files(spark, tmp_dir, layout="flat")
    rows = sorted(r.line for r in C.collate(lines, "app1", "h", "u").collect())
    assert rows == ["10,5", "11,6"]


def test_event_log_inferred_schema_and_file_scope(spark):
    path = event_log_path(spark, SF_SMALL)
    inferred = read_event_log(spark, path, schema=None)
    typed = read_event_log(spark, path, schema=EVENT_LOG_SCHEMA)
    assert inferred.count() == typed.count()
    n_dir = D.normalise(typed, scope="dir").where(F.col("app_id").isNull()).count()
    n_path = D.normalise(typed, scope="path").where(F.col("app_id").isNull()).count()
    assert n_dir == 0 and n_path == 0


def test_written_lines_are_small_files_in_unsorted_folders(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(MAT, "LINES_PER_FILE", 7)
    rows = [(f"{i} " + "same text " * 50, f"a{i % 3}" if i % 10 else None) for i in range(100)]
    lines = spark.createDataFrame(rows, "value string, app string")
    MAT.write_lines(lines, tmp_dir + "/lines", "app")
    files = [os.path.join(d, x) for d, _, names in os.walk(tmp_dir + "/lines") for x in names if x.startswith("part-")]
    assert len(files) >= 100 / 7 and sum(map(os.path.getsize, files)) * 4 < sum(len(v) for v, _ in rows)
    got = spark.read.text(tmp_dir + "/lines")
    assert sorted((r.value, r.app or "") for r in got.collect()) == sorted((v, a or "") for v, a in rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    MAT.write_lines(lines.select("value"), tmp_dir + "/flat")
    assert sorted(r.value for r in spark.read.text(tmp_dir + "/flat").collect()) == sorted(v for v, _ in rows)


def test_log_shuffles_rows_of_events_not_lines(spark, tmp_dir):
    rows = EV._log_rows(task_table(spark, SF_SMALL))
    lines = EV._dealt_lines(rows, 3)
    assert lines.exceptAll(EV.derived_event_log(task_table(spark, SF_SMALL))).count() == 0 and lines.count() == rows.count()
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    # the line is built above the shuffle, which moves a task's columns and the hash of its line
    assert "SparkListenerTaskEnd" in plan[:plan.index("Repartition")] and "[_h#" in plan[plan.index("Repartition"):][:60]
    path = event_log_path(spark, SF_SMALL)
    size = sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(path.removeprefix("file:")) for x in names)
    length = spark.read.text(path).agg(F.sum(F.length("value"))).first()[0]
    assert size * 4 < length  # the lines were written as they are


def test_streaming_events_match_batch(spark, tmp_dir):
    path = event_log_path(spark, SF_SMALL)
    ST.stream_events(spark, path, tmp_dir + "/out", tmp_dir + "/ck")
    streamed = spark.read.parquet(tmp_dir + "/out")
    batch = D.event_rows(D.normalise(read_event_log(spark, path), scope="path"))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
    # a restart with the same checkpoint adds nothing
    ST.stream_events(spark, path, tmp_dir + "/out", tmp_dir + "/ck")
    assert spark.read.parquet(tmp_dir + "/out").count() == batch.count()


def test_epoch_helpers_ignore_session_zone(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.179",)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("ts"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        r = df.select(epoch_seconds(F.col("ts")).alias("s"), epoch_millis(F.col("ts")).alias("ms")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.s == 1704067207 and r.ms == 1704067207179


def test_durations_log_and_listener_forms_agree(spark):
    log = read_event_log(spark, event_log_path(spark, SF_SMALL))
    a = D.durations_from_log(log)
    b = D.durations(D.normalise(log, scope="path")).select(*a.columns)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_totals_log_and_listener_forms_agree(spark):
    log = read_event_log(spark, event_log_path(spark, SF_SMALL))
    norm = D.normalise(log, scope="path")
    for from_log, from_rows in ((D.stage_totals_from_log(log), D.stage_totals(norm)),
                                (D.node_totals_from_log(log), D.node_totals(norm))):
        b = from_rows.select(*from_log.columns)
        assert from_log.count() == b.count() and from_log.exceptAll(b).count() == 0


def test_spread_is_a_no_op_for_many_partitions(spark):
    from clusterlens.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(cores * 2)
    assert spread(many, ("id",)) is many
    one = spark.range(1000).coalesce(1)
    spread_one = spread(one, ("id",))
    assert spread_one.rdd.getNumPartitions() == cores
    assert sorted(r.id for r in spread_one.collect()) == list(range(1000))
