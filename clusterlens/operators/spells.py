"""Dynamic network over spells: horizon, labels, typing, attribute tables,
time slices, active vertices and edges per slice, latest attribute value per
slice, and spells built from runtime events.

Slice activity is an equi-join, not a range join: a spell [o, t) meets the
slice [2i, 2i+2) exactly for i in floor(o/2) .. ceil(t/2)-1 (a point spell
only for i = floor(o/2)), so each spell is exploded into the slice indexes
it overlaps. Work is proportional to the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.operators.ordered import running_sum
from clusterlens.operators.skew import salted_join
from clusterlens.sources.materialize import cut

# The vertex and edge classes and their drawing attributes.
# Colours with alpha are RGBA hex (transparent white, half-transparent
# light green / light blue / red).
VERTEX_ATTRS = [
    # type, size, sides, colour, border, label size
    ("worker", 4.0, 32, "lightgrey", "black", 0.8),
    ("data", 0.1, 32, "#FFFFFF00", "#FFFFFF00", 0.9),
    ("taskLocal", 1.0, 3, "#90EE9080", "black", 0.1),
    ("taskNode", 1.0, 3, "#ADD8E680", "black", 0.1),
    ("taskRack", 1.0, 3, "#FF000080", "black", 0.1),
    ("stage", 4.0, 6, "yellow", "black", 1.0),
]
EDGE_ATTRS = [("taskToNode", "lightgrey"), ("taskToData", "#FFFFFF00"), ("taskToStage", "yellow")]
TASK_TYPES = {"PROCESS_LOCAL": "taskLocal", "NODE_LOCAL": "taskNode", "RACK_LOCAL": "taskRack"}
SLICE_WIDTH = 2


def horizon(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.max("terminus").alias("horizon"))


def labels(vertices: DataFrame) -> DataFrame:
    """Names as drawn: the data vertex unnamed, stages named 'name info'."""
    name = (F.when(F.col("type") == "data", F.lit(""))
            .when(F.col("type") == "stage", F.concat_ws(" ", F.col("name"), F.col("info")))
            .otherwise(F.col("name")))
    return vertices.select("vertex_id", name.alias("label"))


def title(vertices: DataFrame) -> DataFrame:
    """The chart title: ``info`` of the first vertex row."""
    return vertices.agg(F.min_by("info", "ord").alias("title"))


def task_type(type_col: Column, info: Column) -> Column:
    """Tasks typed by locality; other localities (e.g. ANY) give NULL."""
    lookup = F.create_map(*[F.lit(x) for kv in TASK_TYPES.items() for x in kv])
    return F.when(type_col == "task", F.try_element_at(lookup, info)).otherwise(type_col)


def typed_vertices(vertices: DataFrame) -> DataFrame:
    return vertices.withColumn("vclass", task_type(F.col("type"), F.col("info")))


def vertex_attrs(vertices: DataFrame) -> DataFrame:
    """Left join to the 6-row attribute table (broadcast: fixed size);
    vertices of unknown class get NULL attributes."""
    spark = vertices.sparkSession
    attrs = spark.createDataFrame(VERTEX_ATTRS, "vclass string, size double, sides int, colour string, "
                                                "border string, label_size double")
    return typed_vertices(vertices).join(F.broadcast(attrs), "vclass", "left") \
        .select("vertex_id", "vclass", "size", "sides", "colour", "border", "label_size")


def edge_attrs(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    attrs = spark.createDataFrame(EDGE_ATTRS, "type string, colour string")
    return edges.join(F.broadcast(attrs), "type", "left").select("tail", "head", "type", "colour")


def slices(vertices: DataFrame) -> DataFrame:
    """Slice starts 0, 2, ..., up to the horizon; each slice 2 wide."""
    return horizon(vertices).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("horizon"),
                                                         F.lit(SLICE_WIDTH).cast("bigint"))).alias("slice"))


def _slice_range(last_col: Column) -> tuple[Column, Column]:
    """First and last slice index that the spell meets (first > last: none)."""
    a = F.floor(F.col("onset") / SLICE_WIDTH).cast("bigint")
    b = (F.ceil(F.col("terminus") / SLICE_WIDTH) - 1).cast("bigint")
    return F.greatest(a, F.lit(0).cast("bigint")), F.least(F.greatest(a, b), last_col)


def _slice_index(spells: DataFrame, last_col: Column) -> DataFrame:
    lo, hi = _slice_range(last_col)
    return (spells.withColumn("_last", last_col).where(lo <= hi)
            .withColumn("_i", F.explode(F.sequence(lo, hi)))
            .withColumn("slice", F.col("_i") * SLICE_WIDTH)
            .drop("_last", "_i"))


def active_vertices(vertices: DataFrame) -> DataFrame:
    """``(slice, vertex_id)`` for every vertex active in each slice."""
    last = F.floor(horizon(vertices).scalar() / SLICE_WIDTH).cast("bigint")
    return _slice_index(vertices, last).select("slice", "vertex_id")


def _both_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with their slice range (_lo, _hi), clipped to the slices of their
    ends, and the ends' own ranges (_tail, _head). One vertex, such as the data
    vertex, may end a third of all edges: Spark splits such a key (skew joins),
    each row being matched with one row of its vertex."""
    last = F.floor(horizon(vertices).scalar() / SLICE_WIDTH).cast("bigint")
    lo, hi = _slice_range(last)
    spans = vertices.where(lo <= hi).groupBy("vertex_id").agg(
        F.collect_set(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("spans"))
    e = edges.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    for end in ("tail", "head"):
        e = e.join(spans.select(F.col("vertex_id").alias(end), F.col("spans").alias(f"_{end}")), end)
    first = F.greatest("_lo", F.array_min(F.transform("_tail", lambda s: s["lo"])),
                       F.array_min(F.transform("_head", lambda s: s["lo"])))
    final = F.least("_hi", F.array_max(F.transform("_tail", lambda s: s["hi"])),
                    F.array_max(F.transform("_head", lambda s: s["hi"])))
    return e.withColumns({"_lo": first, "_hi": final}).where("_lo <= _hi")


def active_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(slice, tail, head, type)`` for active edges whose two ends are active
    in the same slice; the edge's slices are expanded once, clipped to both ends."""

    def inside(spans: str, i: Column) -> Column:
        return F.exists(spans, lambda s: (s["lo"] <= i) & (i <= s["hi"]))

    e = _both_ends(edges, vertices).withColumn("_i", F.explode(F.sequence("_lo", "_hi")))
    e = e.where(inside("_tail", F.col("_i")) & inside("_head", F.col("_i")))
    return e.select((F.col("_i") * SLICE_WIDTH).alias("slice"), "tail", "head", "type")


def active_runs(spells: DataFrame, vertices: DataFrame, by: str) -> DataFrame:
    """``(by, first_slice, last_slice, active)``: the runs of slices over which as
    many spells of the group are active (at least one), without a row per
    slice. A spell adds one at its first slice and takes it away after its last;
    the sums per slice (combined map-side) are added up in order by a distributed
    prefix sum, so neither a spell that spans everything nor a group that holds
    most spells expands anywhere. ``by`` a class gives counts, ``by`` a vertex its activity."""
    last = F.floor(horizon(vertices).scalar() / SLICE_WIDTH).cast("bigint")
    lo, hi = _slice_range(last)
    steps = spells.select(by, lo.alias("lo"), hi.alias("hi")).where(F.col("lo") <= F.col("hi")).select(
        by, F.inline(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).cast("bigint").alias("step")),
                             F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).cast("bigint").alias("step")))))
    steps = steps.groupBy(by, "at").agg(F.sum("step").alias("step")).where("step <> 0")
    runs = running_sum(steps, by, "at", "step", "active", "until")
    return runs.where("active > 0").select(by, (F.col("at") * SLICE_WIDTH).alias("first_slice"),
                                           ((F.col("until") - 1) * SLICE_WIDTH).alias("last_slice"), "active")


def active_edge_runs(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(tail, head, type, first_slice, last_slice)``: ``active_edges`` as runs of
    slices, one per overlap of the edge's spell with a spell of each end (several
    spells of one vertex that overlap give runs that overlap)."""
    e = _both_ends(edges, vertices)
    e = e.withColumn("_t", F.explode("_tail")).where("_t.lo <= _hi AND _t.hi >= _lo")
    e = e.withColumns({"_lo": F.greatest("_lo", "_t.lo"), "_hi": F.least("_hi", "_t.hi"), "_h": F.explode("_head")})
    e = e.where("_h.lo <= _hi AND _h.hi >= _lo")
    return e.select("tail", "head", "type", (F.greatest("_lo", "_h.lo") * SLICE_WIDTH).alias("first_slice"),
                    (F.least("_hi", "_h.hi") * SLICE_WIDTH).alias("last_slice"))


def latest_attr(attr_spells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per (vertex, slice): the value of the latest-starting attribute spell
    active in the slice (ties broken by ``source``)."""
    last = F.floor(horizon(vertices).scalar() / SLICE_WIDTH).cast("bigint")
    s = _slice_index(attr_spells, last)
    return s.groupBy("vertex_id", "slice").agg(
        F.max_by("value", F.struct("onset", "source")).alias("value"))


def _app_times() -> list[Column]:
    """t0, t1: start and end of the application, as aggregates of its rows."""
    return [F.min(F.when(F.col("event") == "APPLICATION-START", F.col("epoch"))).alias("t0"),
            F.max(F.when(F.col("event") == "APPLICATION-END", F.col("epoch"))).alias("t1")]


def _attr(name: str) -> Column:
    return F.element_at("vals", F.array_position("keys", F.lit(name)).cast("int"))


def _spans(rows: DataFrame, ident: Column) -> DataFrame:
    """``rows`` (one per spell, and those that hold the application's times) with
    onset and terminus in seconds since application start; open ends are closed
    at application start and end. An application may hold all rows, so its times
    are joined with salts. The rows are read several times and the events, from
    which they are an aggregate, once: they are cut."""
    rows = cut(rows, "spells")
    times = rows.groupBy("app_id").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    rows = salted_join(rows.drop("t0", "t1").where("spell"), "app_id", times, [ident])
    return rows.withColumns({"onset": F.coalesce(F.col("s"), F.col("t0")) - F.col("t0"),
                             "terminus": F.coalesce(F.col("e"), F.col("t1")) - F.col("t0")})


def build_spells(norm: DataFrame) -> DataFrame:
    """Vertex spells in seconds since application start from the unified
    runtime-event table: tasks (start..end, info = locality), stages
    (submitted..completed, info = name), workers (executor added .. removed)
    and the data vertex (the whole application). One conditional aggregate per
    (type, id), one pass over the events."""
    ev = norm.where(F.col("kind") == "event")
    e = F.col("event")
    begin = e.isin("TASK-START", "STAGE-SUBMITTED", "EXECUTOR-ADDED")
    kind = (F.when(e.isin("TASK-START", "TASK-END"), "task")
            .when(e.isin("STAGE-SUBMITTED", "STAGE-COMPLETED"), "stage")
            .when(e.isin("EXECUTOR-ADDED", "EXECUTOR-REMOVED"), "worker")
            .when(e.isin("APPLICATION-START", "APPLICATION-END"), "data"))
    ident = (F.when(kind == "task", _attr("taskId")).when(kind == "stage", _attr("stageId"))
             .when(kind == "worker", _attr("executorId")).otherwise(F.lit("")))
    info = (F.when(e == "TASK-START", _attr("taskLocality")).when(e == "STAGE-SUBMITTED", _attr("name"))
            .when(e == "EXECUTOR-ADDED", _attr("node")))
    rows = ev.select("app_id", "epoch", "event", kind.alias("type"), ident.alias("id"), info.alias("info"),
                     begin.alias("begin"))
    rows = rows.where("type IS NOT NULL").groupBy("app_id", "type", "id").agg(
        F.min(F.when(F.col("begin"), F.col("epoch"))).alias("s"),
        F.max(F.when(~F.col("begin") & (F.col("type") != "data"), F.col("epoch"))).alias("e"),
        F.max("info").alias("info"), *_app_times(),
        F.max(F.col("event") != "APPLICATION-END").alias("spell"))  # the end alone makes no data vertex
    rows = _spans(rows, F.col("id"))
    vertex = (F.when(F.col("type") == "task", F.concat(F.lit("T"), F.col("id")))
              .when(F.col("type") == "stage", F.concat(F.lit("S"), F.col("id")))
              .when(F.col("type") == "worker", F.split_part(F.col("info"), F.lit("."), F.lit(1)))
              .otherwise(F.lit("data")))
    text = (F.when(F.col("type") == "worker", F.col("id")).when(F.col("type") == "data", F.lit(""))
            .otherwise(F.col("info")))
    return rows.select("app_id", "onset", "terminus", vertex.alias("vertex_id"), "type", text.alias("info"))


def build_spell_edges(norm: DataFrame) -> DataFrame:
    """Edge spells from the unified runtime-event table: each task is linked to
    its worker node, to the data vertex and to its stage while it runs."""
    ev = norm.where(F.col("kind") == "event")
    start = F.col("event") == "TASK-START"
    of_task = F.col("event").isin("TASK-START", "TASK-END")
    tasks = ev.where(of_task | F.col("event").isin("APPLICATION-START", "APPLICATION-END")).select(
        "app_id", "epoch", "event", of_task.alias("spell"), start.alias("start"),
        *[F.when(of_task, _attr(a)).alias(c) for a, c in (("taskId", "id"), ("node", "node"), ("stageId", "stage"))])
    tasks = tasks.groupBy("app_id", "spell", "id").agg(
        F.min(F.when(F.col("start"), F.col("epoch"))).alias("s"), F.max(F.when(~F.col("start"), F.col("epoch"))).alias("e"),
        F.max("node").alias("node"), F.max("stage").alias("stage"), *_app_times())
    tasks = _spans(tasks, F.col("id"))
    ends = F.array(F.struct(F.col("node").alias("head"), F.lit("taskToNode").alias("type")),
                   F.struct(F.lit("data").alias("head"), F.lit("taskToData").alias("type")),
                   F.struct(F.concat(F.lit("S"), F.col("stage")).alias("head"), F.lit("taskToStage").alias("type")))
    return tasks.select("app_id", "onset", "terminus", F.concat(F.lit("T"), F.col("id")).alias("tail"), F.inline(ends))
