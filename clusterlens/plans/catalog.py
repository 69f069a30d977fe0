"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the benchmark tables in ``sf_dir`` (or inputs Spark derives
from them), so its work grows with the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from clusterlens.functions.numeric import round_sig
from clusterlens.operators import eventlog as EL
from clusterlens.operators import graph as G
from clusterlens.operators import moments as M
from clusterlens.operators import runtime as D
from clusterlens.operators import records as R
from clusterlens.operators import series as FS
from clusterlens.operators import sinkfiles as C
from clusterlens.operators import sketches as K
from clusterlens.operators import spells as H
from clusterlens.operators import stats as S
from clusterlens.operators import text as T
from clusterlens.sources.eventlog import (EVENT_LOG_SCHEMA, applications_log_path, event_log_path, open_log_path,
                                          read_event_log, read_open_log)
from clusterlens.sources.materialize import cut, materialized, write_lines
from clusterlens.sources.edges import read_edge_list, write_edge_list
from clusterlens.sources.series import application_marks, event_marks, node_series, read_marks, read_series
from clusterlens.session import shared_dir, source_key
from clusterlens.sources.filelines import read_numbered_lines
from clusterlens.sources.sinkfiles import (SINK_APP, read_sink_files, redelivered_sink_path, restarted_sink_path,
                                           sink_files_path, sink_name_of_path)
from clusterlens.sources.songs import song_lines
from clusterlens.streaming import jobs as ST
from clusterlens.sources.spells import network_spells, read_edge_spells, read_vertex_spells, task_activity
from clusterlens.sources.tasks import task_table
from clusterlens.sources.corpus import document_lines
from clusterlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        return fn
    return deco


# --- A: text corpus ---------------------------------------------------------

def _freq(spark, sf_dir):
    return T.word_frequency(T.words(document_lines(spark, sf_dir)))


@register("text_line_count")
def text_line_count(spark, sf_dir):
    return T.line_count(document_lines(spark, sf_dir))


@register("text_word_count")
def text_word_count(spark, sf_dir):
    return T.word_total(T.words(document_lines(spark, sf_dir)))


@register("word_counts")
def word_counts(spark, sf_dir):
    return _freq(spark, sf_dir)


@register("distinct_words")
def distinct_words(spark, sf_dir):
    return T.distinct_words(_freq(spark, sf_dir))


@register("word_lookup")
def word_lookup(spark, sf_dir):
    return T.occurrences(_freq(spark, sf_dir))


@register("top_words")
def top_words(spark, sf_dir):
    return T.top_words(_freq(spark, sf_dir))


@register("top_words_report")
def top_words_report(spark, sf_dir):
    return T.report_lines(T.top_words(_freq(spark, sf_dir)))


@register("line_grep")
def line_grep(spark, sf_dir):
    return T.grep_count(document_lines(spark, sf_dir))


@register("char_count")
def char_count(spark, sf_dir):
    return T.char_count(table(spark, sf_dir, "pages"), "html")


def _source_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.lower("text").alias("value"))
    return T.words(docs, keep=("source",))


@register("distinct_words_sketch")
def distinct_words_sketch(spark, sf_dir):
    """Distinct words, exact, and whether the union of the sources' stored states is within its bound."""
    words = _source_words(spark, sf_dir)
    states = cut(K.distinct_states(words, "word", ("source",)), "distinct-states")
    exact = words.agg(F.count_distinct("word").alias("distinct_words"))
    estimate = K.distinct_estimate(K.merge_distinct(states)).scalar()
    off = F.abs(estimate - F.col("distinct_words"))
    return exact.select("distinct_words", (off <= F.col("distinct_words") * K.distinct_error()).alias("within"))


HEAVY = 0.001


@register("heavy_words")
def heavy_words(spark, sf_dir):
    """Words with a share of at least 1/1000: named by the union of the
    sources' stored states, then counted exactly."""
    words = _source_words(spark, sf_dir)
    states = K.merge_frequent(cut(K.frequent_states(words, "word", ("source",)), "frequent-states"))
    named = K.frequent_values(states, HEAVY).select(F.col("value").alias("word"))
    counts = words.join(named, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * 1000 >= states.select("n").scalar())


# --- B: song records and correlation -----------------------------------------

def _parsed(spark, sf_dir, fields=None):
    return R.parse_tracks(song_lines(spark, sf_dir), fields=fields)


_KV = ["track7Id", "songHotness", "tempo"]


def _tracks(spark, sf_dir, fields=None):
    return R.tracks(song_lines(spark, sf_dir), fields=fields)


def _pairs(spark, sf_dir):
    tr = _tracks(spark, sf_dir, _KV)
    return R.hot_pairs(tr), R.tempo_pairs(tr)


def _kv_checkpointed(spark, sf_dir):
    """The narrow (key, hotness, tempo) records, parsed once and written to
    the shared checkpoint folder, for plans that read them several times."""
    return cut(_tracks(spark, sf_dir, _KV), "song-kv")


def _sums(spark, sf_dir):
    # hotness and tempo pairs both come from the parsed records: one pass
    return S.moment_sums_one_table(_tracks(spark, sf_dir, _KV), "songHotness", "tempo")


@register("track_parse")
def track_parse(spark, sf_dir):
    return _tracks(spark, sf_dir)


@register("track_counts")
def track_counts(spark, sf_dir):
    return R.record_counts(_parsed(spark, sf_dir, ["track7Id"]))


@register("hot_pairs")
def hot_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[0]


@register("tempo_pairs")
def tempo_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[1]


@register("pair_join")
def pair_join(spark, sf_dir):
    kv = _kv_checkpointed(spark, sf_dir)
    return S.pair_join(R.hot_pairs(kv), R.tempo_pairs(kv))


@register("moment_columns")
def moment_columns(spark, sf_dir):
    kv = _kv_checkpointed(spark, sf_dir)
    return S.moment_columns(S.pair_join(R.hot_pairs(kv), R.tempo_pairs(kv)), "hotness", "tempo")


@register("pair_keys")
def pair_keys(spark, sf_dir):
    return _sums(spark, sf_dir).select("keys")


_SUM_COLS = ("sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2")


@register("moment_sums")
def moment_sums(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    return sums.select("keys", "rows", *[round_sig(F.col(c)).alias(c) for c in _SUM_COLS])


@register("corr_key_n")
def corr_key_n(spark, sf_dir):
    return S.correlation(_sums(spark, sf_dir), "keys").select(round_sig(F.col("r"), 8).alias("r"))


@register("corr_row_n")
def corr_row_n(spark, sf_dir):
    return S.correlation(_sums(spark, sf_dir), "rows").select(round_sig(F.col("r"), 8).alias("r"))


@register("corr_verdict")
def corr_verdict(spark, sf_dir):
    r = S.correlation(_sums(spark, sf_dir), "keys")
    return r.select(round_sig(F.col("r"), 8).alias("r"), S.verdict(F.col("r")).alias("verdict"))


@register("corr_rank")
def corr_rank(spark, sf_dir):
    # The rank plan reads the pairs several times: parse once into a
    # narrow table and cut the lineage there (reliable checkpoint in the
    # shared checkpoint folder, so a lost executor does not re-parse).
    kv = _kv_checkpointed(spark, sf_dir)
    h = R.value_pairs(kv, "songHotness", "hotness")
    t = R.value_pairs(kv, "tempo", "tempo")
    return S.rank_correlation(h, t, "hotness", "tempo").select(round_sig(F.col("rho"), 8).alias("rho"))


@register("corr_moments")
def corr_moments(spark, sf_dir):
    """r over the joined rows, from centred co-moments."""
    kv = _kv_checkpointed(spark, sf_dir)
    out = M.pair_correlation(R.hot_pairs(kv), R.tempo_pairs(kv), "hotness", "tempo", "track7Id")
    return out.select("rows", round_sig(F.col("r"), 8).alias("r"))


FAR_FROM_ZERO = 1e9


@register("corr_moments_by_artist")
def corr_moments_by_artist(spark, sf_dir):
    """r of duration and tempo per artist, both far from zero, from states kept
    per year: odd and even years come as two batches, the odd ones twice."""
    tr = _tracks(spark, sf_dir, ["artist7Id", "duration", "tempo", "year"])
    rows = cut(tr.select("artist7Id", "year", (F.col("duration") + FAR_FROM_ZERO).alias("x"),
                         (F.col("tempo") + FAR_FROM_ZERO).alias("y")), "song-moments")
    store = shared_dir(spark, "stores", uuid.uuid4().hex)
    for odd in (1, 0, 1):
        states = M.value_states(rows.where(F.col("year") % 2 == odd), "x", "y", ("artist7Id", "year"))
        M.store_states(states, store, "year")
    merged = M.merge_states(M.stored_states(spark, store), ("artist7Id",))
    return merged.select("artist7Id", "n", round_sig(F.col("at_x") - FAR_FROM_ZERO + F.col("mean_x"), 8).alias("avg_duration"),
                         round_sig(M.r_of(), 8).alias("r"))


@register("fade_ratio")
def fade_ratio(spark, sf_dir):
    return R.fade_ratio(_tracks(spark, sf_dir, ["track7Id", "duration", "startOfFadeOut", "danceability",
                                                "endOfFadeIn"]))


@register("song_words")
def song_words(spark, sf_dir):
    return R.song_words(_tracks(spark, sf_dir, ["track7Id", "title"]))


@register("song_word_counts")
def song_word_counts(spark, sf_dir):
    return R.song_word_counts(_tracks(spark, sf_dir, ["artistId", "title"]))


@register("song_words_by_artist")
def song_words_by_artist(spark, sf_dir):
    return R.song_word_counts(_tracks(spark, sf_dir, ["artistId", "title"]), by_artist=True)


@register("playme_flag")
def playme_flag(spark, sf_dir):
    return R.playme_flag(_tracks(spark, sf_dir, ["track7Id", "artistPlaymeId"]))


@register("track_label")
def track_label(spark, sf_dir):
    return R.track_label(_tracks(spark, sf_dir, ["track7Id", "artistName", "title"]))


# --- G: task graphs ------------------------------------------------------------

def _task_stage(spark, sf_dir):
    return G.edges_task_stage(task_table(spark, sf_dir))


@register("edges_task_stage")
def edges_task_stage(spark, sf_dir):
    return _task_stage(spark, sf_dir)


@register("edges_task_node")
def edges_task_node(spark, sf_dir):
    return G.edges_task_node(task_table(spark, sf_dir))


@register("edges_task_second")
def edges_task_second(spark, sf_dir):
    return G.edges_task_second(task_table(spark, sf_dir))


@register("vertices")
def vertices(spark, sf_dir):
    return G.vertices(_task_stage(spark, sf_dir))


@register("simplify")
def simplify(spark, sf_dir):
    return G.simplify(_task_stage(spark, sf_dir))


@register("degree")
def degree(spark, sf_dir):
    return G.degree(_task_stage(spark, sf_dir))


@register("degree_class")
def degree_class(spark, sf_dir):
    return G.degree_class(G.degree(G.edges_task_node(task_table(spark, sf_dir))))


@register("vertex_style")
def vertex_style(spark, sf_dir):
    return G.vertex_style(G.degree(_task_stage(spark, sf_dir)), "stages")


@register("vertex_style_seconds")
def vertex_style_seconds(spark, sf_dir):
    return G.vertex_style(G.degree(G.edges_task_second(task_table(spark, sf_dir))), "seconds")


@register("vertex_style_nodes")
def vertex_style_nodes(spark, sf_dir):
    return G.vertex_style(G.degree(G.edges_task_node(task_table(spark, sf_dir))), "nodes")


@register("edges_from_tsv")
def edges_from_tsv(spark, sf_dir):
    """The task-stage graph through its file form (two tab-separated columns)."""
    path = materialized(spark, sf_dir, "edges", lambda p: write_edge_list(_task_stage(spark, sf_dir), p))
    return read_edge_list(spark, path)


# --- F: node time series ---------------------------------------------------------

def _rebased_marks(spark, sf_dir):
    return FS.rebase(event_marks(spark, sf_dir), FS.origin(node_series(spark, sf_dir)))


@register("series_metrics")
def series_metrics(spark, sf_dir):
    return FS.metric_series(node_series(spark, sf_dir))


@register("series_from_csv")
def series_from_csv(spark, sf_dir):
    """The metrics of a node series read from its CSV form."""
    path = materialized(spark, sf_dir, "series", lambda p: (
        node_series(spark, sf_dir).write.mode("overwrite").csv(p, header=True)))
    return FS.metric_series(read_series(spark, path))


@register("marks_from_csv")
def marks_from_csv(spark, sf_dir):
    """Event marks read from their CSV form, tagged by kind."""
    path = materialized(spark, sf_dir, "marks", lambda p: (
        _rebased_marks(spark, sf_dir).write.mode("overwrite").csv(p, header=True)))
    return FS.split_kind(read_marks(spark, path))


@register("series_origin")
def series_origin(spark, sf_dir):
    return FS.origin(node_series(spark, sf_dir))


@register("event_rebase")
def event_rebase(spark, sf_dir):
    return _rebased_marks(spark, sf_dir)


@register("event_split")
def event_split(spark, sf_dir):
    return FS.split_kind(_rebased_marks(spark, sf_dir))


@register("stage_bands")
def stage_bands(spark, sf_dir):
    return FS.stage_bands(_rebased_marks(spark, sf_dir))


@register("stage_bands_by_app")
def stage_bands_by_app(spark, sf_dir):
    """Bands of each of several applications."""
    return FS.stage_bands(FS.rebase(application_marks(spark, sf_dir), FS.origin(node_series(spark, sf_dir))))


@register("metric_peak")
def metric_peak(spark, sf_dir):
    return FS.metric_peak(FS.metric_series(node_series(spark, sf_dir)))


@register("node_count")
def node_count(spark, sf_dir):
    return FS.node_count(node_series(spark, sf_dir))


@register("series_long")
def series_long(spark, sf_dir):
    return FS.long_form(FS.metric_series(node_series(spark, sf_dir)))


@register("overlay")
def overlay(spark, sf_dir):
    return FS.overlay(_rebased_marks(spark, sf_dir))


@register("band_stats")
def band_stats(spark, sf_dir):
    bands = cut(FS.stage_bands(_rebased_marks(spark, sf_dir)), "bands")  # one row per stage, read twice
    stats = FS.band_stats(FS.metric_series(node_series(spark, sf_dir)), bands)
    return stats.select("band", "node", "samples", *[
        round_sig(F.col(c)).alias(c) for c in stats.columns if c.startswith("avg_")
    ], *[c for c in stats.columns if c.startswith("max_")])


# --- D: runtime events ----------------------------------------------------------

def _log(spark, sf_dir):
    return read_event_log(spark, event_log_path(spark, sf_dir))


def _norm(spark, sf_dir):
    # The derived log keeps one application per folder (app=<id>), like
    # rolling event logs, so the id comes from the path: no second scan.
    return D.normalise(_log(spark, sf_dir), scope="path")


def _rows_like(spark, sf_dir, *prefixes):
    rows = D.event_rows(_norm(spark, sf_dir))
    cond = None
    for p in prefixes:
        c = F.col("event").startswith(p)
        cond = c if cond is None else (cond | c)
    return rows.where(cond)


@register("evt_rows")
def evt_rows(spark, sf_dir):
    return D.event_rows(_norm(spark, sf_dir))


@register("evt_task_start")
def evt_task_start(spark, sf_dir):
    return D.typed(_log(spark, sf_dir), "TASK-START")


@register("evt_task_end")
def evt_task_end(spark, sf_dir):
    return D.typed(_log(spark, sf_dir), "TASK-END")


@register("evt_task_metrics")
def evt_task_metrics(spark, sf_dir):
    return D.typed(_log(spark, sf_dir), "TASK-END", "metric")


@register("evt_stage")
def evt_stage(spark, sf_dir):
    return _rows_like(spark, sf_dir, "STAGE-")


@register("evt_job")
def evt_job(spark, sf_dir):
    return _rows_like(spark, sf_dir, "JOB-")


@register("evt_executor")
def evt_executor(spark, sf_dir):
    return _rows_like(spark, sf_dir, "EXECUTOR-", "BLOCK-MANAGER-")


@register("evt_block")
def evt_block(spark, sf_dir):
    return _rows_like(spark, sf_dir, "BLOCK-UDPATED")


@register("evt_app")
def evt_app(spark, sf_dir):
    return _rows_like(spark, sf_dir, "APPLICATION-")


@register("listener_lines")
def listener_lines(spark, sf_dir):
    return D.listener_lines(_norm(spark, sf_dir))


def _listener_path(spark, sf_dir):
    return materialized(spark, sf_dir, "listener", lambda path: (
        write_lines(D.listener_lines(_norm(spark, sf_dir)), path, "app_id")))


@register("listener_parse")
def listener_parse(spark, sf_dir):
    lines = spark.read.text(_listener_path(spark, sf_dir)).select("value")
    parsed = D.parse_listener_lines(lines)
    return parsed.select("kind", "epoch", "event", D.attrs_text(F.col("keys"), F.col("vals")).alias("attrs"))


def _listener_reasons_path(spark, sf_dir):
    """Listener files in which a failed task's reason is a text of several lines."""
    trace = (",reason,java.lang.RuntimeException: k is zero, retry\n\tat work(Replay.scala:12)\n\n"
             "Caused by: reason,none, \"quoted")
    lines = D.listener_lines(_norm(spark, sf_dir)).select("app_id", F.when(
        F.col("line").endswith(",reason,ExceptionFailure"), F.regexp_replace("line", ",reason,ExceptionFailure$", trace))
        .otherwise(F.col("line")).alias("line"))
    return materialized(spark, sf_dir, "listener-reasons", lambda path: write_lines(lines, path, "app_id"))


@register("listener_records")
def listener_records(spark, sf_dir):
    """Listener rows whose reasons span lines, whole."""
    parsed = D.listener_records(read_numbered_lines(spark, _listener_reasons_path(spark, sf_dir)))
    return parsed.select("kind", "epoch", "event", D.attrs_text(F.col("keys"), F.col("vals")).alias("attrs"))


@register("durations")
def durations(spark, sf_dir):
    return D.durations_from_log(_log(spark, sf_dir))


@register("stage_totals")
def stage_totals(spark, sf_dir):
    return D.stage_totals_from_log(_log(spark, sf_dir))


@register("node_totals")
def node_totals(spark, sf_dir):
    return D.node_totals_from_log(_log(spark, sf_dir))


@register("run_summary")
def run_summary(spark, sf_dir):
    return D.run_summary(_log(spark, sf_dir), scope="path")


def _apps(spark, sf_dir):
    return read_event_log(spark, applications_log_path(spark, sf_dir))


@register("evt_block_updates")
def evt_block_updates(spark, sf_dir):
    """Block updates of several applications: blocks of data sets and of broadcast values."""
    norm = D.normalise(_apps(spark, sf_dir), block_filter=F.lit(True), scope="dir")
    return D.event_rows(norm).where(F.col("event") == "BLOCK-UDPATED")


@register("app_durations")
def app_durations(spark, sf_dir):
    return D.durations_from_log(_apps(spark, sf_dir), scope="dir")


@register("app_stage_totals")
def app_stage_totals(spark, sf_dir):
    return D.stage_totals_from_log(_apps(spark, sf_dir), scope="dir")


@register("app_node_totals")
def app_node_totals(spark, sf_dir):
    return D.node_totals_from_log(_apps(spark, sf_dir), scope="dir")


@register("app_summary")
def app_summary(spark, sf_dir):
    return D.run_summary(_apps(spark, sf_dir), scope="dir")


@register("task_time_quantiles")
def task_time_quantiles(spark, sf_dir):
    """p50, p95 and p99 of task times per stage and node from states kept per
    day: whether the exact rank of each answer is within the stated error."""
    by = ("stage_id", "executor")
    took = task_table(spark, sf_dir).select(
        *by, (F.col("finish_ms") - F.col("launch_ms")).alias("took"), (F.col("launch_ms") / 86_400_000).cast("bigint").alias("day"))
    states = cut(K.quantile_states(took, "took", (*by, "day")), "time-states")
    answers = K.quantiles(K.merge_quantiles(states, by), by)
    ranks = K.quantile_ranks(took, "took", answers, by)
    error = K.rank_error()
    within = (F.col("low") - error <= F.col("q")) & (F.col("q") <= F.col("high") + error)
    return ranks.select(*by, F.col("n").alias("tasks"), "q", within.alias("within"))


# --- E: SQL over the event log -----------------------------------------------------

@register("log_app_id")
def log_app_id(spark, sf_dir):
    return EL.app_id(_log(spark, sf_dir))


@register("log_app_ids")
def log_app_ids(spark, sf_dir):
    return EL.app_ids(_apps(spark, sf_dir))


def _open(spark, sf_dir):
    return read_open_log(spark, open_log_path(spark, sf_dir))


@register("log_event_lines")
def log_event_lines(spark, sf_dir):
    """Lines of each event kind, known or not."""
    return EL.event_shapes(_open(spark, sf_dir)).select("event", "lines")


@register("log_unknown_fields")
def log_unknown_fields(spark, sf_dir):
    return EL.unknown_fields(_open(spark, sf_dir), EVENT_LOG_SCHEMA)


@register("log_heap_by_executor")
def log_heap_by_executor(spark, sf_dir):
    """A field of an event that the explicit schema does not know."""
    rows = EL.field_values(_open(spark, sf_dir), "SparkListenerExecutorMetricsUpdate",
                           executor=("$['Executor ID']", "string"), heap=("$['Metrics Updated'][0].Heap", "bigint"))
    return rows.groupBy("executor").agg(F.count(F.lit(1)).alias("updates"), F.max("heap").alias("heap"))


@register("log_broken_lines")
def log_broken_lines(spark, sf_dir):
    return EL.broken_lines(_open(spark, sf_dir))


@register("log_event_types")
def log_event_types(spark, sf_dir):
    return EL.event_types(_log(spark, sf_dir))


@register("log_executor_adds")
def log_executor_adds(spark, sf_dir):
    return EL.executor_adds(_log(spark, sf_dir))


@register("log_executor_lines")
def log_executor_lines(spark, sf_dir):
    return EL.executor_lines(EL.executor_adds(_log(spark, sf_dir)))


# --- H: dynamic network ------------------------------------------------------------

def _vs(spark, sf_dir):
    return network_spells(spark, sf_dir)[0]


@register("spell_horizon")
def spell_horizon(spark, sf_dir):
    return H.horizon(_vs(spark, sf_dir))


@register("spell_labels")
def spell_labels(spark, sf_dir):
    return H.labels(_vs(spark, sf_dir))


@register("spell_title")
def spell_title(spark, sf_dir):
    return H.title(_vs(spark, sf_dir))


@register("spell_types")
def spell_types(spark, sf_dir):
    return H.typed_vertices(_vs(spark, sf_dir)).select("vertex_id", "vclass")


@register("vertex_attrs")
def vertex_attrs(spark, sf_dir):
    return H.vertex_attrs(_vs(spark, sf_dir))


@register("edge_attrs")
def edge_attrs(spark, sf_dir):
    return H.edge_attrs(network_spells(spark, sf_dir)[1])


@register("slices")
def slices(spark, sf_dir):
    return H.slices(_vs(spark, sf_dir))


@register("active_vertices")
def active_vertices(spark, sf_dir):
    return H.active_vertices(_vs(spark, sf_dir))


@register("active_edges")
def active_edges(spark, sf_dir):
    v, e = network_spells(spark, sf_dir)
    return H.active_edges(e, v)


@register("active_class_runs")
def active_class_runs(spark, sf_dir):
    """Active vertices of each class, as runs of slices."""
    v = H.typed_vertices(_vs(spark, sf_dir))
    return H.active_runs(v.withColumn("vclass", F.coalesce("vclass", F.lit("other"))), v, "vclass")


@register("active_vertex_runs")
def active_vertex_runs(spark, sf_dir):
    """Activity of each vertex, as runs of slices."""
    v = _vs(spark, sf_dir)
    return H.active_runs(v, v, "vertex_id")


@register("active_edge_runs")
def active_edge_runs(spark, sf_dir):
    v, e = network_spells(spark, sf_dir)
    return H.active_edge_runs(e, v)


@register("latest_attr")
def latest_attr(spark, sf_dir):
    return H.latest_attr(task_activity(spark, sf_dir), _vs(spark, sf_dir))


@register("spell_build")
def spell_build(spark, sf_dir):
    return H.build_spells(_norm(spark, sf_dir))


@register("spell_build_edges")
def spell_build_edges(spark, sf_dir):
    return H.build_spell_edges(_norm(spark, sf_dir))


# --- C: metric-sink collation ------------------------------------------------------

SINK_HOST, SINK_USER = "collector.cluster.local", "joe"


def _sink_lines(spark, sf_dir):
    return read_sink_files(spark, sink_files_path(spark, sf_dir))


@register("sink_collate")
def sink_collate(spark, sf_dir):
    return C.collate(_sink_lines(spark, sf_dir), SINK_APP, SINK_HOST, SINK_USER)


@register("sink_append")
def sink_append(spark, sf_dir):
    """The collated rows after being appended to the store, by application."""
    path = materialized(spark, sf_dir, "sink-store", lambda p: C.append_collated(
        C.collate(_sink_lines(spark, sf_dir), SINK_APP, SINK_HOST, SINK_USER), p, SINK_APP))
    return spark.read.parquet(path)


@register("sink_long")
def sink_long(spark, sf_dir):
    return C.long_form(_sink_lines(spark, sf_dir), SINK_APP)


def _restarted_sinks(spark, sf_dir):
    lines = read_numbered_lines(spark, restarted_sink_path(spark, sf_dir))
    return lines.withColumn("sink", sink_name_of_path(F.col("file")))


@register("sink_long_headers")
def sink_long_headers(spark, sf_dir):
    """Long form of sinks whose header changes inside the file."""
    return C.long_form_by_header(_restarted_sinks(spark, sf_dir), SINK_APP)


@register("sink_misfits")
def sink_misfits(spark, sf_dir):
    return C.header_misfits(_restarted_sinks(spark, sf_dir), SINK_APP)


def _stream_out(spark, sf_dir, name, run):
    """Run a streaming job to completion (availableNow) into the shared
    folder and read its committed output back."""
    base = shared_dir(spark, "streams", source_key(sf_dir), name)
    run(base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")


@register("stream_collate")
def stream_collate(spark, sf_dir):
    src = sink_files_path(spark, sf_dir)
    return _stream_out(spark, sf_dir, "collate", lambda out, ck: ST.stream_collate(
        spark, src, out, ck, SINK_APP, SINK_HOST, SINK_USER))


@register("stream_collate_once")
def stream_collate_once(spark, sf_dir):
    """Sink files that are delivered twice, collated once."""
    src = redelivered_sink_path(spark, sf_dir)
    return _stream_out(spark, sf_dir, "collate_once", lambda out, ck: ST.stream_collate_once(
        spark, src, out, ck, SINK_APP, SINK_HOST, SINK_USER))


@register("stream_events")
def stream_events(spark, sf_dir):
    src = event_log_path(spark, sf_dir)
    return _stream_out(spark, sf_dir, "events", lambda out, ck: ST.stream_events(spark, src, out, ck))


def _closed_stream(spark, sf_dir, name, job, **options):
    """A stream over the whole event log with a closing mark, so that all its
    windows come out."""
    src = event_log_path(spark, sf_dir)
    marks = materialized(spark, sf_dir, "closing-marks", lambda path: ST.close_input(spark, path))
    return _stream_out(spark, sf_dir, name, lambda out, ck: job(spark, src, out, ck, marks=marks, **options))


@register("stream_task_rate")
def stream_task_rate(spark, sf_dir):
    return _closed_stream(spark, sf_dir, "task_rate", ST.stream_task_rate)


@register("stream_busy_sessions")
def stream_busy_sessions(spark, sf_dir):
    return _closed_stream(spark, sf_dir, "busy_sessions", ST.stream_busy_sessions)


@register("stream_durations")
def stream_durations(spark, sf_dir):
    """The elapsed times of the batch query, from an interval join of streams."""
    return _closed_stream(spark, sf_dir, "durations", ST.stream_durations, max_run="60 days").drop("start")


@register("stream_slow_tasks")
def stream_slow_tasks(spark, sf_dir):
    """Tasks with the time they took, null for those that had not ended after a minute."""
    return _closed_stream(spark, sf_dir, "slow_tasks", ST.stream_durations, max_run="1 minute", scopes=("task",))


@register("event_marks")
def event_marks_query(spark, sf_dir):
    return FS.marks_from_events(_norm(spark, sf_dir))


@register("spells_from_csv")
def spells_from_csv(spark, sf_dir):
    """Vertex spells read from their CSV form."""
    path = materialized(spark, sf_dir, "vertex-spells", lambda p: (
        network_spells(spark, sf_dir)[0].drop("ord").write.mode("overwrite").csv(p, header=True)))
    return read_vertex_spells(spark, path)


@register("edge_spells_from_csv")
def edge_spells_from_csv(spark, sf_dir):
    """Edge spells read from their CSV form."""
    path = materialized(spark, sf_dir, "edge-spells", lambda p: (
        network_spells(spark, sf_dir)[1].write.mode("overwrite").csv(p, header=True)))
    return read_edge_spells(spark, path)
