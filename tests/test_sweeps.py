"""As-of attribution, bands by application and interval sweeps against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from clusterlens.operators import ordered as O
from clusterlens.operators import series as FS
from clusterlens.operators import spells as H


@pytest.fixture(params=[1, 3, 17])
def ranges(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_last_before(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([7, None, rng.randint(-50, 400)]), i % 5, i % 5) for i in range(300)]
    marks = [(rng.choice([None, 7, rng.randint(0, 300)]), i) for i in range(25)]
    df = spark.createDataFrame(rows, "t long, a int, b int")
    got = O.last_before(df, spark.createDataFrame(marks, "start long, mark int"), "t", "start", ["mark"]).collect()

    def near(t):
        return max(((s, m) for s, m in marks if s is not None and s <= t), default=(0, None))[1]

    assert Counter(map(tuple, got)) == Counter((*r, near(r[0])) for r in rows if r[0] is not None)
    none = spark.createDataFrame([], "start long, mark int")
    assert {r.mark for r in O.last_before(df, none, "t", "start", ["mark"]).collect()} == {None}
    assert O.last_before(df.limit(0), spark.createDataFrame(marks, "start long, mark int"), "t", "start", ["mark"]).count() == 0


def test_a_long_band_and_a_hot_second(spark, ranges):
    year = 365 * 86400
    bands = spark.createDataFrame([(1, 0, year), (2, year, year), (3, year, year + 5)], "band long, start long, end long")
    rows = [(100, "a")] * 200 + [(e, "b") for e in (-1, 0, year - 1, year, year + 4, year + 5)]
    metrics = spark.createDataFrame([(e, n, 1.0, 2.0, 3.0, float(e)) for e, n in rows],
                                    "epoch long, node string, CPU double, MEMUSED double, DISK double, NETWORK double")
    got = {(r.band, r.node): (r.samples, r.max_NETWORK) for r in FS.band_stats(metrics, bands).collect()}
    assert got == {(1, "a"): (200, 100.0), (1, "b"): (2, year - 1.0), (3, "b"): (2, year + 4.0)}
    wide = FS.band_stats(metrics, bands, bucket_seconds=86400 * 30)
    assert got == {(r.band, r.node): (r.samples, r.max_NETWORK) for r in wide.collect()}
    plan = FS.in_bands(metrics, bands)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian|Generate explode\\(sequence\\(floor", plan)


def test_bands_of_applications_do_not_mix(spark, ranges):
    rng = random.Random(2)
    marks = [(rng.randint(0, 50), rng.choice(["stage", "global"]), "e", i, rng.choice(["x", "y", "y", "y", None])) for i in range(80)]
    df = spark.createDataFrame(marks, "epoch long, node string, event string, seq long, app_id string")
    want = []
    for app in ("x", "y", None):
        own = sorted((e, s) for e, n, _, s, a in marks if n == "stage" and a == app)
        want += [(app, k + 1, s, e, own[k + 1][0] if k + 1 < len(own) else e, FS.BAND_COLOURS[k % 2]) for k, (e, s) in enumerate(own)]
    got = FS.stage_bands(df)
    assert Counter((r.app_id, r.band, r.seq, r.start, r.end, r.colour) for r in got.collect()) == Counter(want)


def test_runs_equal_the_expanded_slices(spark, ranges):
    rng = random.Random(5)
    vs = [(a := rng.randint(0, 60), a + rng.choice([0, 0, 1, 2, 5, 40]), f"v{rng.randint(0, 9)}", rng.choice(["t", "u", None]))
          for _ in range(60)] + [(0, 300, "data", "d")]
    v = spark.createDataFrame(vs, "onset long, terminus long, vertex_id string, type string")
    slices = H.active_vertices(v).join(v.select("vertex_id").distinct(), "vertex_id").collect()
    count = Counter((r.vertex_id, r.slice) for r in slices)
    got = Counter()
    for r in H.active_runs(v, v, "vertex_id").collect():
        assert r.first_slice <= r.last_slice
        got.update({(r.vertex_id, s): r.active for s in range(r.first_slice, r.last_slice + 1, 2)})
    assert got == count
    typed = H.active_runs(v.where("type IS NULL"), v, "type").collect()
    assert {r.type for r in typed} == {None} and H.active_runs(v.limit(0), v, "type").count() == 0
    es = [(a := rng.randint(0, 60), a + rng.choice([0, 3, 30]), f"v{rng.randint(0, 9)}", rng.choice(["data", "v1"]), "e")
          for _ in range(50)]
    e = spark.createDataFrame(es, "onset long, terminus long, tail string, head string, type string")
    want, runs = defaultdict(set), defaultdict(set)
    for r in H.active_edges(e, v).collect():
        want[r.tail, r.head].add(r.slice)
    for r in H.active_edge_runs(e, v).collect():
        runs[r.tail, r.head].update(range(r.first_slice, r.last_slice + 1, 2))
    assert runs == want


def test_running_sum(spark, ranges):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(-5, 5)) for g in ("a", "b") for k in rng.sample(range(1000), 40)] + [("c", 1, 1)]
    got = {(r.g, r.k): (r.total, r.next) for r in
           O.running_sum(spark.createDataFrame(rows, "g string, k long, v long"), "g", "k", "v", "total", "next").collect()}
    for g in "abc":
        own, total = sorted((k, v) for h, k, v in rows if h == g), 0
        for (k, v), then in zip(own, [*own[1:], (None, 0)]):
            total += v
            assert got[g, k] == (total, then[0])


def test_running_sum_offsets_are_few(spark, ranges):
    """Offsets are bounded by the ranges, not by the groups."""
    rng = random.Random(2)
    rows = [(f"s{i}", k, 1) for i in range(300) for k in (0, 1)] + [("hot", k, rng.randint(-2, 2)) for k in range(400)]
    rows += [(None, k, 1) for k in range(50)]
    out = O.running_sum(spark.createDataFrame(rows, "g string, k long, v long"), "g", "k", "v", "total", "next")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "rightHint=(strategy=broadcast)" in plan
    got = {(r.g, r.k): (r.total, r.next) for r in out.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own, total = sorted((k, v) for h, k, v in rows if h == g), 0
        for (k, v), then in zip(own, [*own[1:], (None, 0)]):
            total += v
            assert got[g, k] == (total, then[0])


def test_spells_read_the_events_once(spark):
    def row(app, event, epoch, **attrs):
        return (app, "event", epoch, event, list(attrs), list(attrs.values()))

    task = dict(node="n1", taskId="7", stageId="2", executor="1", taskLocality="ANY")
    rows = [row("a", "APPLICATION-START", 100), row("a", "APPLICATION-END", 160), row("a", "TASK-START", 110, **task),
            row("a", "STAGE-SUBMITTED", 105, stageId="2", name="map"), row("a", "EXECUTOR-ADDED", 101, node="n1.x", executorId="1"),
            row("b", "APPLICATION-END", 300), row("b", "TASK-START", 200, **task), row("b", "TASK-END", 210, **task),
            row(None, "TASK-START", 1, **task), ("a", "metric", 150, "TASK-END", ["taskId"], ["7"])]
    norm = spark.createDataFrame(rows, "app_id string, kind string, epoch long, event string, keys array<string>, vals array<string>")
    v, e = H.build_spells(norm), H.build_spell_edges(norm)
    assert v.inputFiles() and e.inputFiles()  # before, every branch of the plan worked the events out again
    assert sorted(map(tuple, v.collect()), key=str) == sorted(
        [("a", 0, 60, "data", "data", ""), ("a", 1, 60, "n1", "worker", "1"), ("a", 5, 60, "S2", "stage", "map"),
         ("a", 10, 60, "T7", "task", "ANY"), ("b", None, None, "T7", "task", "ANY")], key=str)
    assert sorted(map(tuple, e.collect()), key=str) == sorted(
        [(a, o, t, "T7", head, kind) for a, o, t in (("a", 10, 60), ("b", None, None))
         for head, kind in (("n1", "taskToNode"), ("data", "taskToData"), ("S2", "taskToStage"))], key=str)
