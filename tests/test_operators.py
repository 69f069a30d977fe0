"""Operator semantics on literal rows."""

import math

import pytest
from pyspark.sql import functions as F


from clusterlens.operators import graph as G
from clusterlens.operators import records as R
from clusterlens.operators import runtime as D
from clusterlens.operators import series as FS
from clusterlens.operators import sinkfiles as C
from clusterlens.operators import spells as H
from clusterlens.operators import stats as S
from clusterlens.operators import text as T
from clusterlens.operators.ordered import global_position


def test_word_frequency_and_top(spark):
    lines = spark.createDataFrame([("The cat. the CAT;",), ("",), ("(dog) dog?",)], "value string")
    freq = {r.word: r.n for r in T.word_frequency(T.words(lines)).collect()}
    # "" line -> one empty word; "(dog)..." starts with a delimiter -> leading empty word
    assert freq == {"the": 2, "cat": 2, "": 2, "dog": 2}
    top = [tuple(r) for r in T.top_words(T.word_frequency(T.words(lines)), 2).collect()]
    assert top == [("cat", 2), ("dog", 2)]
    assert T.occurrences(T.word_frequency(T.words(lines)), "viva").first().occurrences == 0
    line = T.report_lines(T.top_words(T.word_frequency(T.words(lines)), 1)).first().line
    assert line == " " * 27 + "cat : " + " " * 9 + "2"


def test_fit_partitions_keeps_rows(spark):
    df = spark.range(100)
    assert T.fit_partitions(df, 7).rdd.getNumPartitions() == 7
    assert T.fit_partitions(df.repartition(10), 3).rdd.getNumPartitions() == 3
    assert sorted(r.id for r in T.fit_partitions(df, 7).collect()) == list(range(100))


def _line(**over):
    fields = ["0"] * 34
    for i in (4, 6, 8, 9, 11, 21, 22, 25, 30, 32):
        fields[i] = ""
    for k, v in over.items():
        fields[int(k[1:])] = v
    return ",".join(fields)


def test_track_parse_arity_and_defaults(spark):
    rows = [(_line(f9='"Artist, A"', f24="nan", f27="120.5", f32="K1", f10="-3", f13="0"),),
            (_line(f24="0.5", f27="nan", f32="K1"),), (",".join(["0"] * 33),)]
    lines = spark.createDataFrame(rows, "value string")
    counts = R.record_counts(R.parse_tracks(lines)).first()
    assert (counts.lines, counts.tracks) == (3, 2)
    tr = R.tracks(lines).orderBy("songHotness").collect()
    assert tr[0].artistName == "Artist, A" and tr[0].songHotness == 0.0 and tr[0].tempo == 120.5
    assert R.playme_flag(R.tracks(lines)).orderBy("playme_present").first().playme_present == 0
    fr = [r.fade_ratio for r in R.fade_ratio(R.tracks(lines)).collect()]
    assert all(math.isnan(x) for x in fr)  # 0/0


def test_moments_from_key_aggregates_equal_pair_rows(spark):
    h = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", 9.0)], "track7Id string, x double")
    t = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 5.0), ("b", 7.0)], "track7Id string, y double")
    pairs = S.pair_join(h, t).collect()
    assert len(pairs) == 7
    m = S.moment_sums(h, t, "x", "y").first()
    assert m.keys == 2 and m.rows == 7
    assert m.sum_x == sum(p.x for p in pairs) and m.sum_xy == sum(p.x * p.y for p in pairs)
    assert m.sum_y2 == sum(p.y * p.y for p in pairs)


def test_rank_correlation_matches_pandas(spark):
    h = spark.createDataFrame([(f"k{i % 5}", float(i % 3)) for i in range(20)], "track7Id string, x double")
    t = spark.createDataFrame([(f"k{i % 4}", float((i * 7) % 5)) for i in range(12)], "track7Id string, y double")
    rows = S.pair_join(h, t).toPandas()
    expect = rows["x"].rank().corr(rows["y"].rank())
    got = S.rank_correlation(h, t, "x", "y").first().rho
    assert abs(got - expect) < 1e-12


def test_average_ranks_across_partitions(spark):
    vals = spark.createDataFrame([(float(v), 1 + v % 3) for v in range(50)], "v double, w long")
    ranks = {r.v: r.rank for r in S.average_ranks(vals, "v", "w", partitions=4).collect()}
    before = 0
    for v in range(50):
        w = 1 + v % 3
        assert ranks[float(v)] == before + (w + 1) / 2
        before += w


def test_global_position_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(40)], "a int, b int")
    got = global_position(df, ["a", "b"], partitions=3).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(40))
    assert [(r.a, r.b) for r in got] == sorted((i % 7, i) for i in range(40))


def test_stage_bands(spark):
    marks = spark.createDataFrame([(10, "stage", "s1", 1), (5, "stage", "s0", 2), (10, "global", "g", 3),
                                   (20, "stage", "s2", 4)], "epoch long, node string, event string, seq long")
    b = [tuple(r) for r in FS.stage_bands(marks).orderBy("band").select("band", "start", "end", "colour").collect()]
    assert b == [(1, 5, 10, "pink"), (2, 10, 20, "orange"), (3, 20, 20, "pink")]


def test_band_stats_half_open(spark):
    bands = spark.createDataFrame([(1, 0, 5000), (2, 5000, 5000)], "band long, start long, end long")
    metrics = spark.createDataFrame([(0, "n", 1.0, 1.0, 1.0, 1.0), (4999, "n", 3.0, 1.0, 1.0, 1.0),
                                     (5000, "n", 9.0, 1.0, 1.0, 1.0)],
                                    "epoch long, node string, CPU double, MEMUSED double, DISK double, NETWORK double")
    r = FS.band_stats(metrics, bands, bucket_seconds=1000).collect()
    assert len(r) == 1 and r[0].samples == 2 and r[0].avg_CPU == 2.0


def test_degree_and_simplify(spark):
    e = spark.createDataFrame([("T1", "S0"), ("S0", "T1"), ("T2", "T2"), ("T3", "S0")], "src string, dst string")
    deg = {r.name: r.degree for r in G.degree(e).collect()}
    assert deg == {"T1": 2, "S0": 3, "T2": 2, "T3": 1}
    assert sorted(tuple(r) for r in G.simplify(e).collect()) == [("S0", "T1"), ("S0", "T3")]


def test_slice_activity_point_spells(spark):
    v = spark.createDataFrame([(0, 6, "w", "w", "worker", "x", 0), (2, 2, "p", "p", "task", "ANY", 1),
                               (3, 3, "q", "q", "task", "NODE_LOCAL", 2), (1, 4, "r", "r", "task", "RACK_LOCAL", 3)],
                              "onset long, terminus long, vertex_id string, name string, type string, info string, ord long")
    act = sorted((r.slice, r.vertex_id) for r in H.active_vertices(v).collect())
    # p: point spell at 2 -> slice 2 only; q: point at 3 -> slice 2; r: [1,4) -> slices 0, 2
    assert ("2", "p") not in act
    assert [x for x in act if x[1] in "pqr"] == [(0, "r"), (2, "p"), (2, "q"), (2, "r")]
    types = {r.vertex_id: r.vclass for r in H.typed_vertices(v).collect()}
    assert types["p"] is None and types["q"] == "taskNode"


def test_listener_parse_irregular_lines(spark):
    lines = spark.createDataFrame([
        ("event,100,TASK-END,node,n1,taskId,7,taskType,ResultTask,stageId,0,executor,1,failed,reason,boom, at x,y",),
        ("event,100,STAGE-SUBMITTED,stageId,3,name,\"count at a.scala:1, b\",parentStageIds,1:2,numTasks,4",),
        ("event,100,JOB-END,jobId,0,jobResult,JobFailed(x, y)",),
        ("\tat org.example.Foo(Foo.java:1)",),
        ("event,5,APPLICATION-START",),
    ], "value string")
    got = {r.event: dict(zip(r.keys, r.vals)) for r in D.parse_listener_lines(lines).collect()}
    assert got["TASK-END"]["status"] == "failed" and got["TASK-END"]["reason"] == "boom, at x,y"
    assert got["STAGE-SUBMITTED"]["name"] == "count at a.scala:1, b"
    assert got["JOB-END"]["jobResult"] == "JobFailed(x, y)"
    assert got["APPLICATION-START"] == {}
    assert D.listener_quarantine(lines).count() == 1


def test_sink_collate_rules(spark):
    lines = spark.createDataFrame([
        ("app1.0.jvm.heap.used.csv", "t,value"), ("app1.0.jvm.heap.used.csv", "10,5"),
        ("app1.driver.DAGScheduler.job.all.csv", "10,1"), ("app2.0.jvm.heap.csv", "10,1"),
        ("app1.1.jvm.heap.used.txt", "10,1"),
    ], "sink string, value string")
    rows = [tuple(r) for r in C.collate(lines, "app1", "host.a.b", "u").collect()]
    assert rows == [("host", "0", "jvm_heap_used", "u", "10,5")]
    lf = [tuple(r) for r in C.long_form(lines, "app1").collect()]
    assert lf == [("0", "jvm_heap_used", 10, "value", 5.0)]


def test_band_stats_adaptive_width_short_bands(spark):
    # many one-second bands: the default width follows the band lengths
    bands = spark.createDataFrame([(i + 1, i, i + 1) for i in range(200)], "band long, start long, end long")
    metrics = spark.createDataFrame([(i, "n", float(i), 0.0, 0.0, 0.0) for i in range(0, 200, 3)],
                                    "epoch long, node string, CPU double, MEMUSED double, DISK double, NETWORK double")
    got = {r.band: r.samples for r in FS.band_stats(metrics, bands).collect()}
    assert got == {i + 1: 1 for i in range(0, 200, 3)}


def test_average_ranks_per_group(spark):
    rows = [(g, float(v), 1 + (v + g) % 3) for g in (0, 1) for v in range(30)]
    vals = spark.createDataFrame(rows, "side int, v double, w long")
    got = {(r.side, r.v): r.rank for r in S.average_ranks(vals, "v", "w", partitions=4, group="side").collect()}
    for g in (0, 1):
        before = 0
        for v in range(30):
            w = 1 + (v + g) % 3
            assert got[(g, float(v))] == before + (w + 1) / 2
            before += w


@pytest.mark.parametrize("partitions,reuse", [(4, "true"), (8, "false"), (200, "false")])
def test_global_order_is_the_same_in_every_branch(spark, partitions, reuse):
    """Positions and next values are exact with a payload column, however the
    plan is evaluated."""
    from clusterlens.operators.ordered import global_position, with_next

    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        n = 300_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("seq"), F.col("id").alias("payload"))
        df = df.withColumn("epoch", F.expr("seq div 3"))
        pos = global_position(df, ["epoch", "seq"])
        assert pos.where("pos <> seq OR payload IS NULL").count() == 0 and pos.count() == n
        nxt = with_next(df, ["epoch", "seq"], "epoch", "then")
        wrong = nxt.where(f"pos <> seq OR NOT then <=> CASE WHEN seq < {n} - 1 THEN (seq + 1) div 3 END")
        assert wrong.count() == 0 and nxt.count() == n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_average_ranks_whatever_spark_reuses(spark, reuse):
    from clusterlens.operators.stats import average_ranks

    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(50_000).select((F.col("id") % 2).alias("side"), (F.col("id") * 31 % 50_000).cast("double").alias("v"))
        df = df.groupBy("side", "v").agg(F.lit(2).alias("m"))
        out = average_ranks(df, "v", "m", group="side")
        # per side 25,000 values of parity `side`, each twice: rank = 2 * (values before) + 1.5
        assert out.where("rank <> 2 * floor(v / 2) + 1.5").count() == 0 and out.count() == 50_000
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_no_field_is_dropped(spark):
    from clusterlens.operators.sinkfiles import long_form

    n = 1500
    head = "t," + ",".join(f"f{i}" for i in range(n))
    body = "5," + ",".join(str(i) for i in range(n))
    lines = spark.createDataFrame([("a.1.m.csv", head), ("a.1.m.csv", body)], "sink string, value string")
    assert long_form(lines, "a").count() == n


def test_listener_lines_keep_empty_and_null_values(spark):
    from clusterlens.operators import runtime

    norm = spark.createDataFrame(
        [("a", "event", 5, "JOB-START", ["jobId", "stageIds"], ["3", ""]),
         ("a", "event", 6, "JOB-START", ["jobId", "stageIds"], ["4", None]),
         ("a", "event", 7, "APPLICATION-END", [], [])],
        "app_id string, kind string, epoch long, event string, keys array<string>, vals array<string>")
    lines = [r.line for r in runtime.listener_lines(norm).orderBy("line").collect()]
    assert lines == ["event,5,JOB-START,jobId,3,stageIds,", "event,6,JOB-START,jobId,4,stageIds,",
                     "event,7,APPLICATION-END"]
    back = runtime.parse_listener_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert all(len(r["keys"]) == len(r["vals"]) for r in back.collect())


@pytest.mark.parametrize("text,value", [("\tnan", 0.0), ("\tinf", 0.0), ("\x01 NaN", float("nan")), ("\t1.5", 1.5)])
def test_double_is_trimmed_as_the_jvm_does(spark, text, value):
    from clusterlens.functions.numeric import java_double

    got = spark.createDataFrame([(text,)], "s string").select(java_double(F.col("s")).alias("d")).first().d
    assert got == value or (got != got and value != value)
