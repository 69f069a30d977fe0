"""Records and headers of files larger than a split, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from clusterlens.operators import filelines as FL
from clusterlens.operators import runtime as D
from clusterlens.operators import sinkfiles as C
from clusterlens.sources.filelines import read_numbered_lines
from clusterlens.sources.sinkfiles import SINK_APP, sink_name_of_path


@pytest.fixture(params=[64, 700, 1 << 20])
def splits(spark, request):
    """Files are cut into splits of about this many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, files):
    for name, lines in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("".join(line + "\n" for line in lines))


def brute_records(lines, start):
    out, outside = [], []
    for line in lines:
        if start(line):
            out.append([line])
        elif out:
            out[-1].append(line)
        else:
            outside.append(line)
    return ["\n".join(r) for r in out], outside


def test_records_over_splits(spark, tmp_dir, splits):
    rng = random.Random(splits)
    files = {f"f{i}.txt": [("S" if rng.random() < p else "c") + "x" * rng.randrange(60) if rng.random() < 0.95 else ""
                           for _ in range(n)] for i, (n, p) in enumerate([(300, 0.5), (200, 0.02), (80, 0), (90, 1), (0, 1)])}
    write(tmp_dir, files)
    lines = read_numbered_lines(spark, tmp_dir)
    if splits == 64:
        assert lines.select("file", "block").distinct().count() > 100
    is_start = F.col("value").startswith("S")
    want = [brute_records(v, lambda x: x.startswith("S")) for v in files.values()]
    got = FL.records(lines, is_start, max_blocks=10_000)
    assert sorted(r.value for r in got.collect()) == sorted(x for r, _ in want for x in r)
    left = FL.lines_outside(lines, is_start, max_blocks=10_000)
    assert sorted(r.value for r in left.collect()) == sorted(x for _, o in want for x in o)
    # with a bound no line is lost, and the order within a record stays
    some, rest = (f(lines, is_start, max_blocks=1).collect() for f in (FL.records, FL.lines_outside))
    assert sorted([x for r in some for x in r.value.split("\n")] + [r.value for r in rest]) == \
        sorted(x for v in files.values() for x in v)
    whole = [x for r, _ in want for x in r]
    assert all(any(w.startswith(r.value) for w in whole) for r in some)


def test_listener_reasons_span_lines(spark, tmp_dir, splits):
    write(tmp_dir, {"a": ["\tat nowhere", "event,5,TASK-END,node,n1,taskId,3,failed,reason,Boom: a,b", "\tat x", "", "\tat y,z",
                          "event,6,JOB-START,jobId,0"],
                    "b": ["event,7,JOB-END,jobId,0,jobResult,Failed", "because"]})
    lines = read_numbered_lines(spark, tmp_dir)
    got = {r.epoch: (r.event, dict(zip(r["keys"], r.vals, strict=True))) for r in D.listener_records(lines).collect()}
    assert got == {5: ("TASK-END", {"node": "n1", "taskId": "3", "status": "failed", "reason": "Boom: a,b\n\tat x\n\n\tat y,z"}),
                   6: ("JOB-START", {"jobId": "0"}), 7: ("JOB-END", {"jobId": "0", "jobResult": "Failed\nbecause"})}
    assert [r.value for r in D.listener_outside(lines).collect()] == ["\tat nowhere"]


def test_last_header_above(spark, tmp_dir, splits):
    name = SINK_APP + ".1.jvm.heap.used.csv"
    body = ["9,1"] + ["t,a,b"] + [f"{i},{i},{i + 1}" for i in range(30)] + ["bad,1,2", "7,1", ""] + ["t,b"] + [
        f"{i},{i}" for i in range(40)] + ["50,", "51,zz", "t,b"]
    write(tmp_dir, {name: body, SINK_APP + ".1.DAGScheduler.x.csv": body, "other.1.a.b.csv": body})
    lines = read_numbered_lines(spark, tmp_dir).withColumn("sink", sink_name_of_path(F.col("file")))
    got = sorted((r.epoch, r.field, r.value) for r in C.long_form_by_header(lines, SINK_APP).collect() if r.epoch < 50)
    want = [(i, "a", float(i)) for i in range(30)] + [(i, "b", i + 1.0) for i in range(30)] + [(i, "b", float(i)) for i in range(40)]
    assert got == sorted(want)
    late = C.long_form_by_header(lines, SINK_APP).where("epoch >= 50").collect()
    assert sorted((r.epoch, r.executor, r.metric, r.field, r.value) for r in late) == [
        (50, "1", "jvm_heap_used", "b", None), (51, "1", "jvm_heap_used", "b", None)]
    assert sorted(r.line for r in C.header_misfits(lines, SINK_APP).collect()) == sorted(["9,1", "bad,1,2", "7,1", ""])
    assert C.long_form_by_header(lines.where("false"), SINK_APP).count() == 0
