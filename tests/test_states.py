"""States that merge: centred co-moments, sketches; redelivered sink files;
logs of several applications."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.operators import eventlog as EL
from clusterlens.operators import moments as M
from clusterlens.operators import runtime as D
from clusterlens.operators import sketches as K
from clusterlens.sources.eventlog import EVENT_LOG_SCHEMA, read_event_log, read_open_log
from clusterlens.streaming import jobs as ST

FAR = 1e9


@pytest.fixture(scope="module")
def far_rows():
    rng = random.Random(7)
    out = []
    for i in range(6000):
        x = rng.gauss(0, 1)
        out.append((i % 5, i % 3, FAR + x, FAR + 0.3 * x + rng.gauss(0, 1)))
    return out


def _r(rows):
    x, y = np.array([[r[-2] - FAR, r[-1] - FAR] for r in rows], dtype=np.float64).T
    return np.corrcoef(x, y)[0, 1]


def _merged_r(df, by=()):
    return {tuple(r[c] for c in by): r["r"] for r in M.merge_states(df, by).select(*by, M.r_of().alias("r")).collect()}


def test_states_keep_their_digits_far_from_zero(spark, far_rows):
    df = spark.createDataFrame(far_rows, "g int, batch int, x double, y double")
    for at in (None, (FAR, FAR)):
        states = M.value_states(df, "x", "y", ("g", "batch"), at)
        assert _merged_r(states)[()] == pytest.approx(_r(far_rows), abs=1e-9)
        by_group = _merged_r(states, ("g",))
        assert set(by_group) == {(g,) for g in range(5)}
        for (g,), r in by_group.items():
            assert r == pytest.approx(_r([x for x in far_rows if x[0] == g]), abs=1e-9)


def test_stored_batches_agree_with_one_batch_and_may_come_twice(spark, far_rows, tmp_dir):
    df = spark.createDataFrame(far_rows, "g int, batch int, x double, y double")
    for batch in (0, 1, 2, 1):
        M.store_states(M.value_states(df.where(F.col("batch") == batch), "x", "y", ("g", "batch")), tmp_dir + "/s", "batch")
    merged = M.merge_states(M.stored_states(spark, tmp_dir + "/s"))
    row = merged.select("n", (F.col("at_x") - FAR + F.col("mean_x")).alias("mean"), M.r_of().alias("r")).collect()[0]
    assert row.n == len(far_rows)
    assert row["mean"] == pytest.approx(np.mean([r[2] - FAR for r in far_rows]), abs=1e-6)
    assert row.r == pytest.approx(_r(far_rows), abs=1e-9)


def test_pair_states_equal_the_joined_pairs(spark):
    rng = random.Random(3)
    # key 0 holds a third of all rows; null keys, null and NaN values join with nothing
    h = [(rng.choice([0, 0, 1, 2, 3]), FAR + rng.random()) for _ in range(60)] + [(None, 1.0), (0, None), (1, float("nan"))]
    t = [(rng.choice([0, 0, 1, 2, 4]), FAR + rng.random()) for _ in range(50)] + [(None, 2.0)]
    pairs = [(a, b) for k, a in h for j, b in t if k is not None and k == j and a is not None and a == a]
    got = M.pair_correlation(spark.createDataFrame(h, "k int, x double"), spark.createDataFrame(t, "k int, y double"),
                             "x", "y", "k").collect()[0]
    assert got.rows == len(pairs) and got.r == pytest.approx(_r(pairs), abs=1e-9)


def test_states_of_nothing_of_constants_and_of_a_null_group(spark):
    schema = "g int, x double, y double"
    empty = spark.createDataFrame([], schema)
    assert M.merge_states(M.value_states(empty, "x", "y")).collect() == []
    same = spark.createDataFrame([(None, 2.0, 1.0), (None, 2.0, 3.0), (1, 2.0, None)], schema)
    rows = M.merge_states(M.value_states(same, "x", "y", ("g",)), ("g",)).select("g", "n", M.r_of().alias("r")).collect()
    assert [(r.g, r.n) for r in rows] == [(None, 2)] and np.isnan(rows[0].r)


def test_quantiles_of_two_days_merge_within_the_stated_error(spark):
    rng = random.Random(5)
    values = [(d, int(rng.expovariate(1e-4))) for d in (1, 2) for _ in range(20_000)] + [(1, None)]
    df = spark.createDataFrame(values, "day int, v bigint").withColumn("g", F.lit("a"))
    merged = K.merge_quantiles(K.quantile_states(df, "v", ("g", "day")), ("g",))
    answers = K.quantiles(merged, ("g",), (0.01, 0.5, 0.95, 0.99))
    ranks = K.quantile_ranks(df, "v", answers, ("g",)).collect()
    ordered = sorted(v for _, v in values if v is not None)
    assert len(ranks) == 4
    for r in ranks:
        assert r.n == 40_000 and r.low == np.searchsorted(ordered, r.value) / 40_000
        assert r.low - K.rank_error() <= r.q <= r.high + K.rank_error()


def test_distinct_counts_of_batches_unite(spark):
    df = spark.range(30_000).select((F.col("id") % 20_000).alias("v"), (F.col("id") % 2).alias("batch"))
    states = K.distinct_states(df, "v", ("batch",))
    estimate = K.distinct_estimate(K.merge_distinct(states)).collect()[0].estimate
    assert abs(estimate - 20_000) <= 20_000 * K.distinct_error()


def test_frequent_values_name_every_value_above_the_share(spark):
    rng = random.Random(11)
    words = ["hot"] * 9000 + [f"w{min(int(rng.paretovariate(0.7)), 100_000)}" for _ in range(21_000)]
    df = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)], "w string, batch int")
    merged = K.merge_frequent(K.frequent_states(df, "w", ("batch",), 4096), items=4096)
    got = {r.value for r in K.frequent_values(merged, 0.002, 4096).collect()}
    assert {w for w in set(words) if words.count(w) >= 60} <= got
    with pytest.raises(ValueError):
        K.frequent_values(merged, 0.0005, 4096)


def _write_lines(folder, name, lines):
    import os
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_a_rotated_copy_adds_nothing_after_a_restart(spark, tmp_dir):
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("in", "out", "ck"))
    args = (spark, src, out, ck, "app_1", "c.local", "joe")
    body = [f"{1_700_000_000 + i},{i % 4}.5" for i in range(50)]
    _write_lines(src, "app_1.0.jvm.heap.csv", ["t,value", *body, "no time"])
    ST.stream_collate_once(*args)
    first = sorted(r.line for r in spark.read.parquet(out).collect())
    assert first == sorted(body)
    _write_lines(src, "app_1.0.jvm.heap.csv.1", ["t,value", *body])  # the same file, rotated
    _write_lines(src, "app_1.1.jvm.heap.csv", ["t,value", body[-1], body[-1]])  # the line of another sink is another row
    ST.stream_collate_once(*args)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.executor, r.line) for r in rows) == sorted([("0", x) for x in body] + [("1", body[-1])])


def test_totals_keep_applications_apart_when_ids_come_from_the_start_event(spark, tmp_dir):
    def log(app, node, tasks):
        end = '{"Event":"SparkListenerTaskEnd","Stage ID":%d,"Task Info":{"Task ID":%d,"Host":"%s.x","Finish Time":9000}}'
        return ['{"Event":"SparkListenerApplicationStart","App ID":"%s","Timestamp":1000}' % app,
                *[end % (t % 2, t, node) for t in range(tasks)]]

    _write_lines(f"{tmp_dir}/one", "log", log("a", "n1", 3))
    _write_lines(f"{tmp_dir}/two", "log", log("b", "n1", 5))
    got = read_event_log(spark, f"{tmp_dir}/*")
    stages = {(r.app_id, r.stageId): r.tasks for r in D.stage_totals_from_log(got, "dir").collect()}
    assert stages == {("a", 0): 2, ("a", 1): 1, ("b", 0): 3, ("b", 1): 2}
    assert {(r.app_id, r.node): r.tasks for r in D.node_totals_from_log(got, "dir").collect()} == {("a", "n1"): 3, ("b", "n1"): 5}


def test_a_log_of_unknown_shape_keeps_events_and_fields(spark, tmp_dir):
    _write_lines(f"{tmp_dir}/log", "part", [
        '{"Event":"SparkListenerApplicationStart","App ID":"a","Timestamp":5,"Tier":"gold"}',
        '{"Event":"New","Size":1,"Deep":{"x":[1,2]}}', '{"Event":"New","Size":2.5}', '{"no event":null}', '[1]', "{broken", ""])
    log = read_open_log(spark, f"{tmp_dir}/log")
    shapes = {r.event: (r.lines, r["shape"]) for r in EL.event_shapes(log).collect()}
    assert shapes["New"][0] == 2 and "Deep: OBJECT<x: ARRAY<BIGINT>>" in shapes["New"][1] and "Size" in shapes["New"][1]
    fields = {(r.event, r.field): r.lines for r in EL.unknown_fields(log, EVENT_LOG_SCHEMA).collect()}
    assert fields == {("SparkListenerApplicationStart", "Tier"): 1, ("New", "Size"): 2, ("New", "Deep"): 1, (None, "no event"): 1}
    got = EL.field_values(log, "New", size=("$.Size", "double"), second=("$.Deep.x[1]", "int"), text=("$.Deep", "int")).collect()
    assert sorted((r["size"], r.second, r.text) for r in got) == [(1.0, 2, None), (2.5, None, None)]
    assert "{broken" in {r.line for r in EL.broken_lines(log).collect()}
    assert EL.app_id(read_event_log(spark, f"{tmp_dir}/log")).collect()[0].app_id == "a"  # the explicit schema reads it too


def test_application_ids_join_without_a_shuffle_of_the_log(spark, tmp_dir):
    lines = {"x": ['{"Event":"SparkListenerApplicationStart","App ID":"x1","Timestamp":1000}',
                   '{"Event":"SparkListenerEnvironmentUpdate","Spark Properties":{"spark.executor.cores":"2","spark.default.parallelism":"9"}}',
                   '{"Event":"SparkListenerEnvironmentUpdate","Spark Properties":{"spark.executor.cores":"4","spark.executor.memory":"1g"}}',
                   '{"Event":"SparkListenerApplicationEnd","Timestamp":9500}'],
             "y": ['{"Event":"SparkListenerApplicationStart","App ID":"y1","Timestamp":1000}'], "z": ['{"Event":"SparkListenerOther"}']}
    for app, own in lines.items():
        os.makedirs(f"{tmp_dir}/log/{app}")
        with open(f"{tmp_dir}/log/{app}/part", "w") as f:
            f.write("\n".join(own) + "\n")
    log = spark.read.schema(EVENT_LOG_SCHEMA).option("recursiveFileLookup", "true").json(tmp_dir + "/log")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = D.run_summary(log)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        # only texts of settings are sorted, after the lines were summed up by hash
        above = plan[:plan.index("BroadcastHashJoin")]
        assert "HashAggregate" in above.replace("ObjectHashAggregate", "")
        assert {tuple(r) for r in out.collect()} == {("x1", 8, "9", "?", "1g", "4"), ("y1", None, "?", "?", "?", "?"),
                                                     (None, None, "?", "?", "?", "?")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
