"""Runtime events: normalising a Spark event log into listener-style rows
(kind, epoch seconds, EVENT, ordered key/value attributes), typed per-event
tables, the listener CSV text form and its parser, elapsed times, per-stage
task-metric totals and the run summary.

The normaliser is a single projection over the log: each JSON event maps to
zero, one or two rows (``inline`` of an array of structs), so the log is
scanned once however many event kinds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.strings import quoted_csv_split, short_host
from clusterlens.operators import filelines as FL


def _ms_to_s(c: Column) -> Column:
    return F.floor(c / 1000).cast("bigint")


def _s(c: Column) -> Column:
    return c.cast("string")


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def _ids(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ":")


_TI = "`Task Info`"
_TM = "`Task Metrics`"


def _task_metric_attrs() -> list[tuple[str, Column]]:
    m = F.col(_TM)
    local = _zero(m["Shuffle Read Metrics"]["Local Bytes Read"])
    remote = _zero(m["Shuffle Read Metrics"]["Remote Bytes Read"])
    return [
        ("node", short_host(F.col(_TI)["Host"])),
        ("taskId", _s(F.col(_TI)["Task ID"])),
        ("bytesWritten", _s(_zero(m["Output Metrics"]["Bytes Written"]))),
        ("memoryBytesSpilled", _s(_zero(m["Memory Bytes Spilled"]))),
        ("shuffleBytesWritten", _s(_zero(m["Shuffle Write Metrics"]["Shuffle Bytes Written"]))),
        ("shuffleWriteTime", _s(_zero(m["Shuffle Write Metrics"]["Shuffle Write Time"]))),
        ("shuffleReadLocalBytesRead", _s(local)),
        ("shuffleReadRemoteBytesRead", _s(remote)),
        ("shuffleReadTotalBytesRead", _s(local + remote)),
    ]


def _block_name() -> Column:
    return F.col("`Block Updated Info`")["Block ID"]


def event_specs(block_filter: Column | None = None) -> dict[str, list[tuple[str, str, Column, list]]]:
    """Spark event name -> rows it becomes: (kind, EVENT, epoch, attrs).

    Block updates: the listener's condition ``not broadcast and name starts
    with 'broadcast_'`` can never hold, so by default nothing is emitted;
    pass ``block_filter`` to choose blocks.
    """
    si = F.col("`Stage Info`")
    ti = F.col(_TI)
    bui = F.col("`Block Updated Info`")
    name = _block_name()
    if block_filter is None:
        block_filter = (~name.startswith("broadcast_")) & name.startswith("broadcast_")
    level = bui["Storage Level"]
    level_text = F.concat_ws(" ", F.when(level["Use Disk"], "Disk"), F.when(level["Use Memory"], "Memory"),
                             F.when(level["Deserialized"], "Deserialized"),
                             F.concat(_s(level["Replication"]), F.lit("x Replicated")))
    return {
        "SparkListenerApplicationStart": [
            ("event", "APPLICATION-START", F.col("Timestamp"), [])],
        "SparkListenerBlockManagerAdded": [
            ("event", "BLOCK-MANAGER-ADDED", F.col("Timestamp"),
             [("host", F.col("`Block Manager ID`")["Host"]),
              ("executor", F.col("`Block Manager ID`")["Executor ID"])])],
        "SparkListenerBlockUpdated": [
            ("event", "BLOCK-UDPATED", F.col("Timestamp"),
             [("node", bui["Block Manager ID"]["Host"]), ("name", name)]),
            ("metric", "BLOCK-UDPATED", F.col("Timestamp"),
             [("blockId", name), ("isRDD", _s(name.startswith("rdd_"))),
              ("isShuffle", _s(name.startswith("shuffle_"))), ("host", bui["Block Manager ID"]["Host"]),
              ("diskSize", _s(_zero(bui["Disk Size"]))), ("externalBlockStoreSize", F.lit("0")),
              ("memSize", _s(_zero(bui["Memory Size"]))), ("storageLevel", level_text)])],
        "SparkListenerExecutorAdded": [
            ("event", "EXECUTOR-ADDED", F.col("Timestamp"),
             [("node", F.col("`Executor Info`")["Host"]), ("executorId", F.col("`Executor ID`"))])],
        "SparkListenerExecutorRemoved": [
            ("event", "EXECUTOR-REMOVED", F.col("Timestamp"), [("executorId", F.col("`Executor ID`"))])],
        "SparkListenerJobStart": [
            ("event", "JOB-START", F.col("`Submission Time`"),
             [("jobId", _s(F.col("`Job ID`"))), ("stageIds", _ids(F.col("`Stage IDs`")))])],
        "SparkListenerJobEnd": [
            ("event", "JOB-END", F.col("`Completion Time`"),
             [("jobId", _s(F.col("`Job ID`"))), ("jobResult", F.col("`Job Result`")["Result"])])],
        "SparkListenerStageSubmitted": [
            ("event", "STAGE-SUBMITTED", si["Submission Time"],
             [("stageId", _s(si["Stage ID"])), ("name", si["Stage Name"]),
              ("parentStageIds", _ids(si["Parent IDs"])), ("numTasks", _s(si["Number of Tasks"]))])],
        "SparkListenerStageCompleted": [
            ("event", "STAGE-COMPLETED", si["Completion Time"],
             [("stageId", _s(si["Stage ID"])),
              ("reason", F.coalesce(si["Failure Reason"], F.lit("succeeded")))])],
        "SparkListenerTaskStart": [
            ("event", "TASK-START", ti["Launch Time"],
             [("node", short_host(ti["Host"])), ("taskId", _s(ti["Task ID"])),
              ("stageId", _s(F.col("`Stage ID`"))), ("executor", ti["Executor ID"]),
              ("taskLocality", ti["Locality"])])],
        "SparkListenerTaskEnd": [
            ("event", "TASK-END", ti["Finish Time"],
             [("node", short_host(ti["Host"])), ("taskId", _s(ti["Task ID"])),
              ("taskType", F.col("`Task Type`")), ("stageId", _s(F.col("`Stage ID`"))),
              ("executor", ti["Executor ID"]),
              ("status", F.when(ti["Failed"], "failed").otherwise("succeeded")),
              ("reason", F.col("`Task End Reason`")["Reason"])]),
            ("metric", "TASK-END", ti["Finish Time"], _task_metric_attrs())],
        "SparkListenerApplicationEnd": [
            ("event", "APPLICATION-END", F.col("Timestamp"), [])],
    }


_ROW_TYPE = "struct<kind:string,epoch:bigint,event:string,keys:array<string>,vals:array<string>>"


def _row(kind: str, event: str, epoch: Column, attrs: list) -> Column:
    keys = F.array(*[F.lit(k) for k, _ in attrs]) if attrs else F.array().cast("array<string>")
    vals = F.array(*[v.cast("string") for _, v in attrs]) if attrs else F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), _ms_to_s(epoch).alias("epoch"), F.lit(event).alias("event"),
                    keys.alias("keys"), vals.alias("vals"))


def with_app_id(log: DataFrame, scope: str = "dir") -> DataFrame:
    """Attach ``app_id`` to every log line from the application-start event
    of its log: all files in one folder (``scope='dir'``: rolling logs, or
    a Spark-written log) or each file alone (``scope='file'``: a flat folder
    of single-file logs). The small side has one row per log."""
    path = F.col("_metadata.file_path")
    if scope == "path":
        # No join (usable on a stream): the id is in the folder name, as in
        # rolling logs (eventlog_v2_<id>/...) or a Spark-written log (app=<id>/...).
        app = F.regexp_extract(path, r"(?:app=|eventlog_v2_)([^/]+)/[^/]*$", 1)
        return log.select("*", F.when(app != "", app).alias("app_id"))
    unit = path if scope == "file" else F.regexp_replace(path, "/[^/]*$", "")
    lines = log.select("*", unit.alias("_file"))
    apps = (lines.where(F.col("Event") == "SparkListenerApplicationStart")
            .groupBy("_file").agg(F.min("`App ID`").alias("app_id")))
    # one row per log: broadcast, as its size is not known beforehand and the
    # lines would be shuffled by a few keys, all lines of a log to one task
    return lines.join(F.broadcast(apps), "_file", "left").drop("_file")


def normalise(log: DataFrame, block_filter: Column | None = None, scope: str = "dir") -> DataFrame:
    """The unified event table ``(app_id, kind, epoch, event, keys, vals)``."""
    specs = event_specs(block_filter)
    rows = None
    for spark_event, outs in specs.items():
        cond = F.col("Event") == spark_event
        if spark_event == "SparkListenerBlockUpdated":
            cond = cond & (block_filter if block_filter is not None
                           else ((~_block_name().startswith("broadcast_")) & _block_name().startswith("broadcast_")))
        value = F.array(*[_row(*o) for o in outs])
        rows = F.when(cond, value) if rows is None else rows.when(cond, value)
    rows = rows.otherwise(F.array().cast(f"array<{_ROW_TYPE}>"))
    return with_app_id(log, scope).select("app_id", F.inline(rows))


def attrs_text(keys: Column, vals: Column) -> Column:
    """Canonical text of the attributes: ``k=v|k=v`` in order."""
    return F.array_join(F.transform(F.arrays_zip(keys.alias("k"), vals.alias("v")),
                                    lambda x: F.concat(x["k"], F.lit("="), F.coalesce(x["v"], F.lit("")))), "|")


def event_rows(norm: DataFrame) -> DataFrame:
    return norm.select("app_id", "kind", "epoch", "event", attrs_text(F.col("keys"), F.col("vals")).alias("attrs"))


def typed(log: DataFrame, event: str, kind: str = "event") -> DataFrame:
    """One typed table for one listener row type: ``epoch`` plus one
    column per attribute, straight from the log (no map building)."""
    for spark_event, outs in event_specs().items():
        for k, name, epoch, attrs in outs:
            if name == event and k == kind:
                return (log.where(F.col("Event") == spark_event)
                        .select(_ms_to_s(epoch).alias("epoch"), *[v.alias(a) for a, v in attrs]))
    raise KeyError(event)


def listener_lines(norm: DataFrame) -> DataFrame:
    """The listener CSV text: ``kind,epoch,EVENT[,key,value]*``, the stage
    name quoted and the task status written bare (no key)."""
    def pair(x: Column) -> Column:
        v = F.coalesce(x["v"], F.lit(""))
        return (F.when(x["k"] == "status", v)
                .when(x["k"] == "name", F.concat(x["k"], F.lit(',"'), v, F.lit('"')))
                .otherwise(F.concat(x["k"], F.lit(","), v)))

    pairs = F.transform(F.arrays_zip(F.col("keys").alias("k"), F.col("vals").alias("v")), pair)
    head = F.concat_ws(",", F.col("kind"), F.col("epoch").cast("string"), F.col("event"))
    line = F.when(F.size("keys") > 0, F.concat(head, F.lit(","), F.array_join(pairs, ","))).otherwise(head)
    return norm.select("app_id", line.alias("line"))


_LINE_OK = r"^(event|metric),[0-9]+,[A-Z-]+(,|\z)"
_TAIL = r"(?s)^(.*?),(reason|jobResult),(.*)\z"


def parse_listener_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse listener CSV lines back to ``(kind, epoch, event, keys, vals)``.

    The format is irregular: the task status has no key, and ``reason`` /
    ``jobResult`` values are unquoted and may hold commas. So the tail
    ``,reason,...`` / ``,jobResult,...`` is cut off first, a final lone
    ``succeeded``/``failed`` gets the key ``status``, the rest is split as
    quoted CSV into key/value pairs, and the tail pair is put back. Lines
    that do not start like a listener row are left out (see
    ``listener_quarantine``).
    """
    line = F.col(col)
    ev = F.regexp_extract(line, r"^[^,]*,[^,]*,([A-Z-]+)", 1)
    cut = ev.isin("TASK-END", "STAGE-COMPLETED", "JOB-END") & line.rlike(_TAIL)
    head = F.when(cut, F.regexp_extract(line, _TAIL, 1)).otherwise(line)
    head = F.regexp_replace(head, r",(succeeded|failed)\z", ",status,$1")
    df = (lines.where(line.rlike(_LINE_OK))
          .select(quoted_csv_split(head).alias("f"),
                  F.when(cut, F.regexp_extract(line, _TAIL, 2)).alias("tk"),
                  F.when(cut, F.regexp_extract(line, _TAIL, 3)).alias("tv")))
    body = F.slice(F.col("f"), 4, F.greatest(F.size("f") - 3, F.lit(0)))
    keys = F.filter(body, lambda x, i: i % 2 == 0)
    vals = F.filter(body, lambda x, i: i % 2 == 1)
    tail_k = F.when(F.col("tk").isNotNull(), F.array(F.col("tk"))).otherwise(F.array().cast("array<string>"))
    tail_v = F.when(F.col("tk").isNotNull(), F.array(F.col("tv"))).otherwise(F.array().cast("array<string>"))
    return df.select(F.element_at("f", 1).alias("kind"), F.element_at("f", 2).cast("bigint").alias("epoch"),
                     F.element_at("f", 3).alias("event"), F.concat(keys, tail_k).alias("keys"),
                     F.concat(vals, tail_v).alias("vals"))


def listener_records(lines: DataFrame, max_blocks: int = 8) -> DataFrame:
    """Listener rows of files whose reasons span lines, from numbered lines:
    a line that starts like a listener row opens a record, the lines below it
    belong to its last value (a continuation line of that very form cannot be
    told from a row). ``listener_outside`` has the lines of no record."""
    return parse_listener_lines(FL.records(lines, F.col("value").rlike(_LINE_OK), max_blocks))


def listener_outside(lines: DataFrame, max_blocks: int = 8) -> DataFrame:
    """Numbered lines above a file's first listener row, and lines more than
    ``max_blocks`` splits below the row they would continue."""
    return FL.lines_outside(lines, F.col("value").rlike(_LINE_OK), max_blocks)


def listener_quarantine(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines that are not listener rows (e.g. stack-trace continuations)."""
    return lines.where(~F.col(col).rlike(_LINE_OK))


def _attr(name: str) -> Column:
    return F.element_at(F.map_from_arrays(F.col("keys"), F.col("vals")), F.lit(name))


def _scope_and_id() -> tuple[Column, Column]:
    """What a start or end row is about: app, job, stage or task, and its id."""
    event = F.col("event")
    ids = (("APPLICATION-", "app", F.col("app_id")), ("JOB-", "job", _attr("jobId")),
           ("STAGE-", "stage", _attr("stageId")), ("TASK-", "task", _attr("taskId")))
    scope = ident = F
    for prefix, name, value in ids:
        scope, ident = scope.when(event.startswith(prefix), F.lit(name)), ident.when(event.startswith(prefix), value)
    return scope, ident


STARTS = ("APPLICATION-START", "JOB-START", "STAGE-SUBMITTED", "TASK-START")
ENDS = ("APPLICATION-END", "JOB-END", "STAGE-COMPLETED", "TASK-END")
SCOPES = ("app", "job", "stage", "task")


def boundaries(norm: DataFrame, events: tuple[str, ...]) -> DataFrame:
    """``(app_id, scope, id, epoch)`` of the start or of the end rows; rows
    without a time or an id are left out (``boundaries_from_log`` is the form
    for event logs)."""
    scope, ident = _scope_and_id()
    rows = norm.where((F.col("kind") == "event") & F.col("event").isin(*events))
    return (rows.select("app_id", scope.alias("scope"), ident.alias("id"), "epoch")
            .where(F.col("epoch").isNotNull() & F.col("id").isNotNull() & F.col("app_id").isNotNull()))


def durations(norm: DataFrame) -> DataFrame:
    """Elapsed seconds per application, job, stage and task: end epoch minus
    start epoch, as conditional min/max per id (one aggregate, no
    self-join)."""
    ev = norm.where(F.col("kind") == "event")
    scope, ident = _scope_and_id()
    is_start, is_end = F.col("event").isin(*STARTS), F.col("event").isin(*ENDS)
    return (ev.select("app_id", scope.alias("scope"), ident.alias("id"), "epoch", is_start.alias("s"),
                      is_end.alias("e"))
            .where(F.col("scope").isNotNull())
            .groupBy("app_id", "scope", "id")
            .agg((F.max(F.when(F.col("e"), F.col("epoch"))) - F.min(F.when(F.col("s"), F.col("epoch"))))
                 .alias("elapsed")))


def _spans() -> list[tuple[str, str, str, Column, Column | None, Column | None]]:
    """What starts and ends in a log: (event of the log, row it becomes, scope, id, start time, end time)."""
    si, ti = F.col("`Stage Info`"), F.col("`Task Info`")
    return [
        ("SparkListenerApplicationStart", "APPLICATION-START", "app", F.col("app_id"), F.col("Timestamp"), None),
        ("SparkListenerApplicationEnd", "APPLICATION-END", "app", F.col("app_id"), None, F.col("Timestamp")),
        ("SparkListenerJobStart", "JOB-START", "job", _s(F.col("`Job ID`")), F.col("`Submission Time`"), None),
        ("SparkListenerJobEnd", "JOB-END", "job", _s(F.col("`Job ID`")), None, F.col("`Completion Time`")),
        ("SparkListenerStageSubmitted", "STAGE-SUBMITTED", "stage", _s(si["Stage ID"]), si["Submission Time"], None),
        ("SparkListenerStageCompleted", "STAGE-COMPLETED", "stage", _s(si["Stage ID"]), None, si["Completion Time"]),
        ("SparkListenerTaskStart", "TASK-START", "task", _s(ti["Task ID"]), ti["Launch Time"], None),
        ("SparkListenerTaskEnd", "TASK-END", "task", _s(ti["Task ID"]), None, ti["Finish Time"]),
    ]


def boundaries_from_log(log: DataFrame, events: tuple[str, ...], scopes: tuple[str, ...] = SCOPES,
                        scope: str = "path") -> DataFrame:
    """``boundaries`` of ``scopes`` straight from the typed log columns: the
    reader gets the events to keep and only the columns they are known by."""
    spans = [x for x in _spans() if x[1] in events and x[2] in scopes]
    e = F.col("Event")
    sc = ident = epoch = F
    for name, _, sco, idc, st, en in spans:
        sc, ident = sc.when(e == name, F.lit(sco)), ident.when(e == name, idc)
        epoch = epoch.when(e == name, _ms_to_s(en if st is None else st))
    rows = with_app_id(log.where(e.isin(*[x[0] for x in spans])), scope)
    return (rows.select("app_id", sc.alias("scope"), ident.alias("id"), epoch.alias("epoch"))
            .where(F.col("epoch").isNotNull() & F.col("id").isNotNull() & F.col("app_id").isNotNull()))


def durations_from_log(log: DataFrame, scope: str = "path") -> DataFrame:
    """``durations`` straight from the typed log columns: one scan and one
    aggregate, no attribute maps (``durations`` is the form for listener
    files)."""
    e = F.col("Event")
    spec = _spans()
    sc = ident = start = end = None
    for name, _, sco, idc, st, en in spec:
        c = e == name
        sc = F.when(c, F.lit(sco)) if sc is None else sc.when(c, F.lit(sco))
        ident = F.when(c, idc) if ident is None else ident.when(c, idc)
        if st is not None:
            start = F.when(c, _ms_to_s(st)) if start is None else start.when(c, _ms_to_s(st))
        if en is not None:
            end = F.when(c, _ms_to_s(en)) if end is None else end.when(c, _ms_to_s(en))
    rows = with_app_id(log.where(e.isin(*[x[0] for x in spec])), scope)
    return (rows.select("app_id", sc.alias("scope"), ident.alias("id"), start.alias("s"), end.alias("e"))
            .groupBy("app_id", "scope", "id")
            .agg((F.max("e") - F.min("s")).alias("elapsed")))


METRIC_KEYS = ("bytesWritten", "memoryBytesSpilled", "shuffleBytesWritten", "shuffleWriteTime",
               "shuffleReadLocalBytesRead", "shuffleReadRemoteBytesRead", "shuffleReadTotalBytesRead")


def stage_totals(norm: DataFrame) -> DataFrame:
    """Task-metric totals per stage: metric rows joined to task-start rows on
    (app, taskId) — both one row per task, so the join is balanced."""
    m = (norm.where((F.col("kind") == "metric") & (F.col("event") == "TASK-END"))
         .select("app_id", _attr("taskId").alias("taskId"),
                 *[_attr(k).cast("bigint").alias(k) for k in METRIC_KEYS]))
    s = (norm.where((F.col("kind") == "event") & (F.col("event") == "TASK-START"))
         .select("app_id", _attr("taskId").alias("taskId"), _attr("stageId").cast("bigint").alias("stageId")))
    return (m.join(s, ["app_id", "taskId"], "inner").groupBy("app_id", "stageId")
            .agg(F.count(F.lit(1)).alias("tasks"), *[F.sum(k).alias(k) for k in METRIC_KEYS]))


def stage_totals_from_log(log: DataFrame, scope: str = "path") -> DataFrame:
    """Per-stage task-metric totals straight from the event log: each
    ``SparkListenerTaskEnd`` carries both the stage id and the metrics, so
    this is one scan and one aggregate, with no join (``stage_totals`` is the
    form for listener files, whose metric rows lack the stage)."""
    ends = with_app_id(log, scope).where(F.col("Event") == "SparkListenerTaskEnd")
    attrs = dict(_task_metric_attrs())
    return (ends.groupBy("app_id", F.col("`Stage ID`").alias("stageId"))
            .agg(F.count(F.lit(1)).alias("tasks"),
                 *[F.sum(attrs[k].cast("bigint")).alias(k) for k in METRIC_KEYS]))


def node_totals_from_log(log: DataFrame, scope: str = "path") -> DataFrame:
    """Per-node task-metric totals straight from ``SparkListenerTaskEnd``
    events: one scan, one aggregate (``node_totals`` is the listener form)."""
    ends = with_app_id(log, scope).where(F.col("Event") == "SparkListenerTaskEnd")
    attrs = dict(_task_metric_attrs())
    return (ends.groupBy("app_id", attrs["node"].alias("node"))
            .agg(F.count(F.lit(1)).alias("tasks"),
                 *[F.sum(attrs[k].cast("bigint")).alias(k) for k in METRIC_KEYS]))


def node_totals(norm: DataFrame) -> DataFrame:
    """Task-metric totals per node (the metric rows carry the node)."""
    m = norm.where((F.col("kind") == "metric") & (F.col("event") == "TASK-END"))
    return (m.groupBy("app_id", _attr("node").alias("node"))
            .agg(F.count(F.lit(1)).alias("tasks"), *[F.sum(_attr(k).cast("bigint")).alias(k) for k in METRIC_KEYS]))


def run_summary(log: DataFrame, scope: str = "dir") -> DataFrame:
    """Per application: elapsed seconds, and from the recorded Spark properties
    the partitions asked for, executors, executor RAM and cores ('?' when
    unknown)."""
    withapp = with_app_id(log, scope)
    props = F.col("`Spark Properties`")
    settings = {
        "partitions": F.coalesce(F.element_at(props, F.lit("spark.default.parallelism")),
                                 F.element_at(props, F.lit("spark.sql.shuffle.partitions"))),
        "executors": F.element_at(props, F.lit("spark.executor.instances")),
        "memory": F.element_at(props, F.lit("spark.executor.memory")),
        "cores": F.element_at(props, F.lit("spark.executor.cores"))}
    # a maximum of texts makes Spark sort its input: the lines are first summed up by
    # hash for each set of settings (null on nearly all lines)
    sets = withapp.groupBy("app_id", *[c.alias(name) for name, c in settings.items()]).agg(
        F.max(F.when(F.col("Event") == "SparkListenerApplicationEnd", F.col("Timestamp"))).alias("end"),
        F.min(F.when(F.col("Event") == "SparkListenerApplicationStart", F.col("Timestamp"))).alias("start"))
    agg = sets.groupBy("app_id").agg(F.max("end").alias("end"), F.min("start").alias("start"),
                                     *[F.max(name).alias(name) for name in settings])
    return agg.select("app_id", F.floor((F.col("end") - F.col("start")) / 1000).cast("bigint").alias("elapsed"),
                      *[F.coalesce(F.col(c), F.lit("?")).alias(c)
                        for c in ("partitions", "executors", "memory", "cores")])
