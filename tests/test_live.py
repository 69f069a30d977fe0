"""Live durations, windows and sessions: everything comes out once, over restarts."""

import json
import os

import pytest

from clusterlens.operators import runtime as D
from clusterlens.sources.eventlog import BOUNDARY_SCHEMA, read_event_log
from clusterlens.streaming import jobs as ST


def task(i, launch, finish):
    info = {"Task ID": i, "Host": f"n{i % 2}.local", "Executor ID": "1", "Launch Time": launch * 1000, "Locality": "ANY"}
    out = [{"Event": "SparkListenerTaskStart", "Stage ID": 0, "Task Info": info}]
    if finish is not None:
        out.append({"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task Type": "ResultTask", "Task End Reason": {"Reason": "Success"},
                    "Task Info": {**info, "Finish Time": finish * 1000, "Failed": False}})
    return out


def put(folder, name, events):
    path = os.path.join(folder, "app=a1")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("".join(json.dumps(e) + "\n" for e in events))


T0 = 1_700_000_000
FIRST = [(1, 0, 10), (2, 5, 4000), (3, 20, None), (4, 4000, None)]
SECOND = [(5, 9000, 9100), (6, 9000, None), (7, 20000, 20001)]


def rows(spark, out, *columns):
    return sorted((tuple(r[c] for c in columns) for r in spark.read.parquet(out).collect()), key=repr)


def log(tasks, late_end=()):
    return [e for i, a, b in tasks for e in task(i, T0 + a, None if b is None else T0 + b)] + list(late_end)


def test_durations_over_restarts(spark, tmp_dir):
    src, out, ck, marks = (os.path.join(tmp_dir, x) for x in ("log", "out", "ck", "marks"))
    run = lambda: ST.stream_durations(spark, src, out, ck, max_run="1 hour", scopes=("task",), marks=marks)
    put(src, "1.json", log(FIRST))
    run()
    assert [r[0] for r in rows(spark, out, "id", "elapsed")] == ["1"]  # the others are still open
    put(src, "2.json", [task(4, T0 + 4000, T0 + 5000)[1], *log(SECOND)])
    run()
    ST.close_input(spark, marks)
    run()
    want = [("1", 10), ("2", None), ("3", None), ("4", 1000), ("5", 100), ("6", None), ("7", 1)]
    assert rows(spark, out, "id", "elapsed") == want
    run()
    assert rows(spark, out, "id", "elapsed") == want  # a restart adds nothing
    batch = D.durations(D.normalise(read_event_log(spark, src), scope="path")).where("scope = 'task'")
    got = {r.id: r.elapsed for r in batch.collect()}
    assert {i: e for i, e in want if e is not None} == {i: e for i, e in got.items() if e is not None and e <= 3600}


@pytest.mark.parametrize("job", [ST.stream_task_rate, ST.stream_busy_sessions])
def test_windows_come_out_once(spark, tmp_dir, job):
    src, out, ck, marks = (os.path.join(tmp_dir, x) for x in ("log", "out", "ck", "marks"))
    put(src, "1.json", log(FIRST))
    job(spark, src, out, ck, marks=marks)
    put(src, "2.json", log(SECOND))
    job(spark, src, out, ck, marks=marks)
    ends = [(i, T0 + b) for i, _, b in FIRST + SECOND if b is not None]
    open_windows = sum(r[0] for r in rows(spark, out, "tasks"))
    assert open_windows < len(ends)
    ST.close_input(spark, marks, T0 + 40_000)  # a mark that leaves room for later days
    job(spark, src, out, ck, marks=marks)
    want = {}
    for i, end in ends:
        start = end // 3600 * 3600 if job is ST.stream_task_rate else end
        key = (start, start + (3600 if job is ST.stream_task_rate else 600), f"n{i % 2}")
        want[key] = want.get(key, 0) + 1
    columns = ("window_start", "window_end", "node", "tasks")
    assert rows(spark, out, *columns) == sorted(((*k, n) for k, n in want.items()), key=repr)
    put(src, "3.json", log([(9, 90_000, 90_001)]))
    job(spark, src, out, ck, marks=marks)
    ST.close_input(spark, marks)
    job(spark, src, out, ck, marks=marks)
    got = rows(spark, out, *columns)
    assert len(got) == len(want) + 1 and all(r[2] is not None for r in got)


@pytest.mark.parametrize("which", [D.STARTS, D.ENDS])
def test_boundaries_of_a_log_need_no_attributes(spark, tmp_dir, which):
    src = os.path.join(tmp_dir, "log")
    stage = {"Stage ID": 3, "Stage Name": "s", "Number of Tasks": 1, "Parent IDs": [], "Submission Time": 1999, "Completion Time": -1}
    odd = [{"Event": "SparkListenerApplicationStart", "App ID": "other", "Timestamp": 1234}, {"Event": "SparkListenerApplicationEnd"},
           {"Event": "SparkListenerJobStart", "Job ID": 7, "Submission Time": 5}, {"Event": "SparkListenerJobEnd", "Job ID": None, "Completion Time": 9},
           {"Event": "SparkListenerJobEnd", "Job ID": 7, "Completion Time": 9000, "Job Result": {"Result": "JobSucceeded"}},
           {"Event": "SparkListenerStageSubmitted", "Stage Info": stage}, {"Stage Info": stage, "Event": "SparkListenerStageCompleted"},
           {"Event": "SparkListenerTaskEnd", "Task Info": None}, {"Event": "SparkListenerTaskStart", "Task Info": {"Task ID": "x", "Launch Time": 4}},
           {"Event": "SparkListenerExecutorAdded", "Timestamp": 1}, {"Timestamp": 1}, {"Event": None}]
    put(src, "1.json", log(FIRST) + odd)
    with open(os.path.join(src, "app=a1", "2.json"), "w") as f:
        f.write('{"Event":"SparkListenerTaskStart","Task Info":{"Task ID":8\nnot json\n\n')
    nameless = os.path.join(tmp_dir, "nameless")  # no application in its path
    os.makedirs(nameless)
    with open(os.path.join(nameless, "loose.json"), "w") as f:
        f.write(json.dumps(task(1, 1, 2)[0]) + "\n")
    for folder in (src, nameless):
        whole = D.boundaries(D.normalise(read_event_log(spark, folder), scope="path"), which).collect()
        assert bool(whole) == (folder == src)
        for scopes in (D.SCOPES, ("task",), ("app", "stage")):
            got = D.boundaries_from_log(read_event_log(spark, folder, BOUNDARY_SCHEMA), which, scopes)
            assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in whole if r.scope in scopes)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Generate" not in plan and "SparkListener" in plan.split("PushedFilters")[1]


def test_stream_of_durations_builds_no_attributes(spark, tmp_dir):
    src = os.path.join(tmp_dir, "log")
    put(src, "1.json", log(FIRST))
    stream = ST.boundary_stream(spark, src, D.STARTS, ("task",))
    assert stream.isStreaming and stream.columns == ["app_id", "scope", "id", "epoch"]
    assert "inline" not in stream._jdf.queryExecution().analyzed().toString()
