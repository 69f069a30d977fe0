"""Task graphs: edge builders from the task model, and undirected-graph
vertex operators (vertex set, simplification, degree, classes, style).

Degree is one partial+final hash aggregate over both edge ends, so a hub
vertex (e.g. a stage with a third of all tasks) costs one row per map task
in the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vertex style per graph kind, (task, other) pairs of
# (size, label font size), from the three task-graph charts.
VERTEX_STYLE = {
    "stages": ((4, 0.4), (20, 0.7)),
    "seconds": ((2, 0.1), (15, 0.9)),
    "nodes": ((2, 0.1), (5, 0.7)),
}


def task_name(task_id: Column) -> Column:
    return F.concat(F.lit("T"), task_id.cast("string"))


def edges_task_stage(tasks: DataFrame) -> DataFrame:
    return tasks.select(task_name(F.col("task_id")).alias("src"),
                        F.concat(F.lit("S"), F.col("stage_id").cast("string")).alias("dst"))


def edges_task_node(tasks: DataFrame) -> DataFrame:
    return tasks.select(task_name(F.col("task_id")).alias("src"),
                        F.split_part(F.col("host"), F.lit("."), F.lit(1)).alias("dst"))


def edges_task_second(tasks: DataFrame) -> DataFrame:
    """One edge per epoch second a task ran, first to last inclusive. The
    output grows with total task-seconds, which is the result itself."""
    first = F.floor(F.col("launch_ms") / 1000).cast("bigint")
    last = F.floor(F.col("finish_ms") / 1000).cast("bigint")
    return (tasks.select(task_name(F.col("task_id")).alias("src"),
                         F.explode(F.sequence(first, F.greatest(first, last))).alias("sec"))
            .select("src", F.col("sec").cast("string").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def simplify(edges: DataFrame) -> DataFrame:
    """Merge multi-edges (undirected) and drop loops."""
    return (edges.where(F.col("src") != F.col("dst"))
            .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .distinct())


def degree(edges: DataFrame) -> DataFrame:
    """Undirected degree; multi-edges count, a loop counts twice."""
    return (edges.select(F.explode(F.array("src", "dst")).alias("name"))
            .groupBy("name").agg(F.count(F.lit(1)).alias("degree")))


def is_task(name: Column) -> Column:
    return F.substring(name, 1, 1) == "T"


def degree_class(deg: DataFrame) -> DataFrame:
    return deg.select("name", "degree",
                      F.when(F.col("degree") > 2, "green").otherwise("white").alias("colour"))


def vertex_style(deg: DataFrame, kind: str = "stages") -> DataFrame:
    """Size, label font size, label and colour of every vertex for one of
    the three task graphs (colour by degree, or by name for 'seconds')."""
    (t_size, t_font), (o_size, o_font) = VERTEX_STYLE[kind]
    task = is_task(F.col("name"))
    if kind == "seconds":
        colour = F.when(task, "white").otherwise("green")
    else:
        colour = F.when(F.col("degree") > 2, "green").otherwise("white")
    return deg.select(
        "name", "degree",
        task.alias("is_task"),
        F.when(task, t_size).otherwise(o_size).alias("size"),
        F.when(task, F.lit(t_font)).otherwise(F.lit(o_font)).alias("font"),
        F.when(task, F.lit("")).otherwise(F.col("name")).alias("label"),
        colour.alias("colour"))
