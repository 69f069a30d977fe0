"""SQL twins of the registered queries, written for DuckDB over the same
parquet tables (views named after the tables). They recompute every result
from the raw tables, independently of the Spark code paths."""

from __future__ import annotations

# --- shared fragments -------------------------------------------------------

# Lines of documents: one final line break adds no line, '' has no lines.
DOC_LINES = r"""
doc_lines AS (
  SELECT doc_id, unnest(CASE WHEN text = '' THEN []::VARCHAR[]
         ELSE string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END) AS value
  FROM documents
)"""

# JVM split on '[ .;:()?"]+' (trailing empties dropped, leading kept).
WORDS = r"""
doc_words AS (
  SELECT unnest(CASE WHEN value = '' THEN ['']
         WHEN regexp_replace(value, '[ .;:()?"]+$', '') = '' THEN []::VARCHAR[]
         ELSE string_split_regex(regexp_replace(value, '[ .;:()?"]+$', ''), '[ .;:()?"]+') END) AS word
  FROM doc_lines
),
freq AS (SELECT lower(word) AS word, count(*) AS n FROM doc_words GROUP BY 1)"""

TEXT = "WITH " + DOC_LINES + "," + WORDS

SQL: dict[str, str] = {
    "text_line_count": "WITH " + DOC_LINES + " SELECT count(*) AS lines FROM doc_lines",
    "text_word_count": TEXT + " SELECT count(*) AS words FROM doc_words",
    "word_counts": TEXT + " SELECT word, n FROM freq",
    "distinct_words": TEXT + " SELECT count(*) AS distinct_words FROM freq",
    "word_lookup": TEXT + " SELECT 'viva' AS word, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences"
                          " FROM freq WHERE word = lower('viva')",
    "top_words": TEXT + " SELECT word, n FROM freq WHERE word <> '' ORDER BY n DESC, word ASC LIMIT 10",
    "top_words_report": TEXT + " SELECT word, n, format('{:>30} : {:>10d}', word, n) AS line FROM freq"
                               " WHERE word <> '' ORDER BY n DESC, word ASC LIMIT 10",
    "line_grep": "WITH " + DOC_LINES + " SELECT count(*) AS matching_lines FROM doc_lines"
                 " WHERE contains(value, 'Processing')",
    "char_count": "SELECT CAST(coalesce(sum(length(html)), 0) AS BIGINT) AS chars FROM pages",
}


# --- B: song records ---------------------------------------------------------

# Parsed records straight from the source columns (line number 7 has 33
# fields and does not parse; 'nan' is not a JVM double, so it reads as 0.0).
TRACKS = r"""
tracks AS (
  SELECT 0 AS sampleRate, CAST(l_suppkey AS INTEGER) AS artist7Id, 0.0::DOUBLE AS artistFamiliarity,
         0.0::DOUBLE AS artistHotness, 'AR' || l_suppkey AS artistId, 0.0::DOUBLE AS artistLong, '' AS artistLocation,
         0.0::DOUBLE AS artistLat, '' AS artistMbid, 'Artist, ' || l_suppkey AS artistName,
         CAST(l_suppkey - 50 AS INTEGER) AS artistPlaymeId, '' AS audioMd5, l_discount AS danceability,
         l_quantity AS duration, l_tax AS endOfFadeIn, 0.0::DOUBLE AS energy, 0 AS "key", 0.0::DOUBLE AS keyConfidence,
         0.0::DOUBLE AS loudness, 0 AS "mode", 0.0::DOUBLE AS modeConfidence, '' AS "unknown", '' AS "release",
         0 AS release7Id, CASE WHEN l_linenumber = 6 THEN 0.0::DOUBLE ELSE l_discount END AS songHotness,
         '' AS songId, l_quantity / 2 AS startOfFadeOut, l_tax * 1000 AS tempo, 0 AS timeSignature,
         0.0::DOUBLE AS timeSignatureConfidence, replace(p_name, '"', '') AS title,
         CAST(l_partkey AS INTEGER) AS trackId, 'TR' || l_orderkey || '-' || l_linenumber AS track7Id,
         CAST(year(l_shipdate) AS INTEGER) AS "year"
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_linenumber <> 7
),
hp AS (SELECT track7Id, songHotness AS hotness FROM tracks WHERE songHotness <> 0),
tp AS (SELECT track7Id, tempo FROM tracks WHERE tempo <> 0),
pj AS (SELECT hp.track7Id, hotness, tempo FROM hp JOIN tp ON hp.track7Id = tp.track7Id),
sums AS (
  SELECT count(DISTINCT track7Id) AS keys, count(*) AS rows, sum(hotness) AS sum_x,
         sum(tempo) AS sum_y, sum(hotness * tempo) AS sum_xy, sum(hotness * hotness) AS sum_x2,
         sum(tempo * tempo) AS sum_y2
  FROM pj
)"""

SONG = "WITH " + TRACKS


def _sig(expr: str, digits: int = 10) -> str:
    return f"CAST(printf('%.{digits - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def _pearson(n: str, sx: str, sy: str, sxy: str, sxx: str, syy: str) -> str:
    return (f"(({n}) * {sxy} - {sx} * {sy}) / "
            f"(sqrt(({n}) * {sxx} - {sx} * {sx}) * sqrt(({n}) * {syy} - {sy} * {sy}))")


def _verdict(r: str) -> str:
    return (f"CASE WHEN isnan({r}) THEN 'almost no correlation [but that does not mean independence]' "
            f"WHEN {r} >= 0.5 THEN 'a reasonable, positive correlation' "
            f"WHEN {r} <= -0.5 THEN 'a reasonable, negative correlation' "
            f"WHEN abs({r}) >= 0.1 THEN 'a weak correlation' "
            f"ELSE 'almost no correlation [but that does not mean independence]' END")


_R_KEYS = _pearson("CAST(keys AS DOUBLE)", "sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2")
_R_ROWS = _pearson("CAST(rows AS DOUBLE)", "sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2")
_STOP = "['a', 'the', 'you', 'he', 'she', 'me', 'i', 'they', 'yours', 'there''s']"
# JVM split of the lower-cased title on single spaces (trailing empties dropped).
_TITLE_WORDS = (r"""(CASE WHEN title = '' THEN [''] WHEN regexp_replace(lower(title), ' +$', '') = ''
     THEN []::VARCHAR[] ELSE string_split(regexp_replace(lower(title), ' +$', ''), ' ') END)""")

SQL.update({
    "track_parse": SONG + " SELECT * FROM tracks",
    "track_counts": SONG + " SELECT (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS lines,"
                           " (SELECT count(*) FROM tracks) AS tracks",
    "hot_pairs": SONG + " SELECT * FROM hp",
    "tempo_pairs": SONG + " SELECT * FROM tp",
    "pair_join": SONG + " SELECT * FROM pj",
    "pair_keys": SONG + " SELECT count(DISTINCT track7Id) AS keys FROM pj",
    "moment_sums": SONG + " SELECT keys, rows, " + ", ".join(
        f"{_sig(c)} AS {c}" for c in ("sum_x", "sum_y", "sum_xy", "sum_x2", "sum_y2")) + " FROM sums",
    "corr_key_n": SONG + f" SELECT {_sig(_R_KEYS, 8)} AS r FROM sums",
    "corr_row_n": SONG + f" SELECT {_sig(_R_ROWS, 8)} AS r FROM sums",
    "corr_verdict": SONG + f" SELECT {_sig(_R_KEYS, 8)} AS r, {_verdict(_R_KEYS)} AS verdict FROM sums",
    "corr_rank": SONG + """,
ranked AS (
  SELECT rank() OVER (ORDER BY hotness) + (count(*) OVER (PARTITION BY hotness) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY tempo) + (count(*) OVER (PARTITION BY tempo) - 1) / 2.0 AS ry
  FROM pj
),
rs AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * ry) AS sxy,
              sum(rx * rx) AS sxx, sum(ry * ry) AS syy FROM ranked)
SELECT """ + _sig(_pearson("n", "sx", "sy", "sxy", "sxx", "syy"), 8) + " AS rho FROM rs",
    "fade_ratio": SONG + " SELECT track7Id, ((duration - startOfFadeOut) + (danceability - endOfFadeIn))"
                         " / duration AS fade_ratio FROM tracks",
    "song_words": SONG + f""", w AS (SELECT track7Id, unnest({_TITLE_WORDS}) AS word FROM tracks)
SELECT track7Id, word, 1 AS one FROM w WHERE NOT list_contains({_STOP}, word)""",
    "song_word_counts": SONG + f""", w AS (SELECT unnest({_TITLE_WORDS}) AS word FROM tracks)
SELECT word, count(*) AS n FROM w WHERE NOT list_contains({_STOP}, word) GROUP BY word""",
    "song_words_by_artist": SONG + f""", w AS (SELECT artistId, unnest({_TITLE_WORDS}) AS word FROM tracks)
SELECT artistId, word, count(*) AS n FROM w WHERE NOT list_contains({_STOP}, word) GROUP BY artistId, word""",
    "playme_flag": SONG + " SELECT track7Id, CASE WHEN artistPlaymeId < 0 THEN 0 ELSE 1 END AS playme_present"
                          " FROM tracks",
    "track_label": SONG + " SELECT track7Id, 'Artist:' || chr(9) || artistName || chr(10) || 'SongTitle:'"
                          " || chr(9) || title AS label FROM tracks",
})


# --- G: task graphs --------------------------------------------------------------

TASKS = r"""
stages AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS stage_id
           FROM (SELECT DISTINCT event_type FROM events)),
tasks AS (
  SELECT e.event_id AS task_id, epoch_us(e.ts) // 1000 AS launch_ms,
         epoch_us(e.ts) // 1000 + CAST(round(e.value * 1000) AS BIGINT) AS finish_ms,
         s.stage_id, e.event_type, 'n' || (e.user_id % 8) || '.cluster.local' AS host,
         CAST(e.user_id % 8 AS VARCHAR) AS executor,
         ['PROCESS_LOCAL', 'NODE_LOCAL', 'RACK_LOCAL', 'ANY'][e.event_id % 4 + 1] AS locality,
         (e.event_type = 'error' AND CAST(json_extract_string(e.props, '$.k') AS BIGINT) = 0) AS failed,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS bytes_written,
         e.event_id % 10 <> 0 AS has_metrics
  FROM events e JOIN stages s ON e.event_type = s.event_type
),
ts_edges AS (SELECT 'T' || task_id AS src, 'S' || stage_id AS dst FROM tasks),
tn_edges AS (SELECT 'T' || task_id AS src, split_part(host, '.', 1) AS dst FROM tasks)"""

GRAPH = "WITH " + TASKS


def _degree(edges: str) -> str:
    return (f"(SELECT name, count(*) AS degree FROM (SELECT src AS name FROM {edges} "
            f"UNION ALL SELECT dst FROM {edges}) GROUP BY name)")


SQL.update({
    "edges_task_stage": GRAPH + " SELECT * FROM ts_edges",
    "edges_task_node": GRAPH + " SELECT * FROM tn_edges",
    "edges_task_second": GRAPH + """ SELECT 'T' || task_id AS src, CAST(unnest(range(
        CAST(floor(launch_ms / 1000) AS BIGINT),
        greatest(CAST(floor(launch_ms / 1000) AS BIGINT), CAST(floor(finish_ms / 1000) AS BIGINT)) + 1)) AS VARCHAR) AS dst
        FROM tasks""",
    "vertices": GRAPH + " SELECT DISTINCT name FROM (SELECT src AS name FROM ts_edges UNION ALL"
                        " SELECT dst FROM ts_edges)",
    "simplify": GRAPH + " SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ts_edges"
                        " WHERE src <> dst",
    "degree": GRAPH + " SELECT * FROM " + _degree("ts_edges"),
    "degree_class": GRAPH + " SELECT name, degree, CASE WHEN degree > 2 THEN 'green' ELSE 'white' END"
                            " AS colour FROM " + _degree("tn_edges"),
    "vertex_style": GRAPH + """ SELECT name, degree, substr(name, 1, 1) = 'T' AS is_task,
        CASE WHEN substr(name, 1, 1) = 'T' THEN 4 ELSE 20 END AS size,
        CASE WHEN substr(name, 1, 1) = 'T' THEN 0.4 ELSE 0.7 END::DOUBLE AS font,
        CASE WHEN substr(name, 1, 1) = 'T' THEN '' ELSE name END AS label,
        CASE WHEN degree > 2 THEN 'green' ELSE 'white' END AS colour
        FROM """ + _degree("ts_edges"),
})

# --- F: node time series ---------------------------------------------------------

SERIES = r"""
series AS (
  SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT) + l_linenumber AS epoch, 'n' || (l_suppkey % 8) AS node,
         l_quantity * 2 AS idl, l_extendedprice AS used, l_quantity AS free,
         CAST(l_linenumber AS DOUBLE) AS buff, CAST(l_partkey AS DOUBLE) AS cach, l_discount AS writ,
         l_tax AS "read", l_quantity AS recv, CAST(l_linenumber AS DOUBLE) AS send
  FROM lineitem
),
origin AS (SELECT min(epoch) AS origin FROM series),
metrics AS (
  SELECT epoch - (SELECT origin FROM origin) AS epoch, node, 100 - idl AS CPU,
         used / (free + buff + cach) * 100 AS MEMUSED, writ + "read" AS DISK, recv + send AS NETWORK
  FROM series
),
marks AS (
  SELECT CAST(floor(epoch(ts)) AS BIGINT) - 883612800 - (SELECT origin FROM origin) AS epoch,
         CASE WHEN event_type = 'signup' THEN 'stage' WHEN event_type = 'error' THEN 'global'
              ELSE 'n' || (user_id % 8) END AS node,
         event_type AS event, event_id AS seq
  FROM events
),
bands AS (
  SELECT row_number() OVER (ORDER BY epoch, seq) AS band, seq, event, epoch AS start,
         coalesce(lead(epoch) OVER (ORDER BY epoch, seq), epoch) AS "end"
  FROM marks WHERE node = 'stage'
)"""

SER = "WITH " + SERIES
_KIND = "CASE WHEN node = 'global' THEN 'global' WHEN node = 'stage' THEN 'stage' ELSE 'node' END"
_M = ("CPU", "MEMUSED", "DISK", "NETWORK")

SQL.update({
    "series_metrics": SER + " SELECT * FROM metrics",
    "series_origin": SER + " SELECT origin FROM origin",
    "event_rebase": SER + " SELECT * FROM marks",
    "event_split": SER + f" SELECT *, {_KIND} AS kind FROM marks",
    "stage_bands": SER + " SELECT band, seq, event, start, \"end\", CASE WHEN band % 2 = 1 THEN 'pink'"
                         " ELSE 'orange' END AS colour FROM bands",
    "stage_bands_by_app": SER + """ SELECT app_id, band, seq, event, start, "end",
        CASE WHEN band % 2 = 1 THEN 'pink' ELSE 'orange' END AS colour FROM (
          SELECT app_id, row_number() OVER w AS band, seq, event, epoch AS start,
                 coalesce(lead(epoch) OVER w, epoch) AS "end"
          FROM (SELECT *, 'app-' || (seq % 3) AS app_id FROM marks) WHERE node = 'stage'
          WINDOW w AS (PARTITION BY app_id ORDER BY epoch, seq))""",
    "metric_peak": SER + " SELECT " + ", ".join(f"max({m}) AS max_{m}" for m in _M) + " FROM metrics",
    "node_count": SER + " SELECT count(DISTINCT node) AS nodes FROM series",
    "series_long": SER + " SELECT node, epoch, metric, value FROM (" + " UNION ALL ".join(
        f"SELECT node, epoch, '{m}' AS metric, {m} AS value FROM metrics" for m in _M) + ")",
    "overlay": SER + f" SELECT epoch, event, {_KIND} AS kind, seq, CASE WHEN {_KIND} = 'node' THEN node"
                     " ELSE '*' END AS panel FROM marks",
    "band_stats": SER + " SELECT band, node, count(*) AS samples, " + ", ".join(
        f"{_sig(f'avg({m})')} AS avg_{m}" for m in _M) + ", " + ", ".join(
        f"max({m}) AS max_{m}" for m in _M) + """ FROM metrics JOIN bands
        ON metrics.epoch >= bands.start AND metrics.epoch < bands."end" GROUP BY band, node""",
})


# --- D / E: runtime events and the event log ------------------------------------------

APP = "'app-20240101000000-0000'"
RUNTIME = TASKS + r""",
app AS (SELECT min(launch_ms) AS start_ms, max(finish_ms) AS end_ms FROM tasks),
hosts AS (SELECT host, executor, min(launch_ms) AS first_ms, max(finish_ms) AS last_ms
          FROM tasks GROUP BY host, executor),
stg AS (SELECT stage_id, event_type, min(launch_ms) AS first_ms, max(finish_ms) AS last_ms,
               count(*) AS n FROM tasks GROUP BY stage_id, event_type),
tm AS (
  SELECT *, split_part(host, '.', 1) AS node,
         CASE WHEN has_metrics THEN coalesce(bytes_written, 0) ELSE 0 END AS bw,
         CASE WHEN has_metrics THEN coalesce(bytes_written, 0) * 10 ELSE 0 END AS sbw,
         CASE WHEN has_metrics THEN finish_ms - launch_ms ELSE 0 END AS swt,
         CASE WHEN has_metrics THEN task_id % 1000 ELSE 0 END AS loc,
         CASE WHEN has_metrics THEN task_id % 7 * 100 ELSE 0 END AS rem,
         CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS status,
         CASE WHEN failed THEN 'ExceptionFailure' ELSE 'Success' END AS reason
  FROM tasks
),
evt AS (
  SELECT 'event' AS kind, start_ms // 1000 AS epoch, 'APPLICATION-START' AS event, '' AS attrs,
         '' AS csv FROM app
  UNION ALL SELECT 'event', first_ms // 1000, 'BLOCK-MANAGER-ADDED', 'host=' || host || '|executor=' || executor,
         'host,' || host || ',executor,' || executor FROM hosts
  UNION ALL SELECT 'event', first_ms // 1000, 'EXECUTOR-ADDED', 'node=' || host || '|executorId=' || executor,
         'node,' || host || ',executorId,' || executor FROM hosts
  UNION ALL SELECT 'event', last_ms // 1000, 'EXECUTOR-REMOVED', 'executorId=' || executor,
         'executorId,' || executor FROM hosts
  UNION ALL SELECT 'event', start_ms // 1000, 'JOB-START',
         'jobId=0|stageIds=' || (SELECT string_agg(CAST(stage_id AS VARCHAR), ':' ORDER BY stage_id) FROM stg),
         'jobId,0,stageIds,' || (SELECT string_agg(CAST(stage_id AS VARCHAR), ':' ORDER BY stage_id) FROM stg)
         FROM app
  UNION ALL SELECT 'event', end_ms // 1000, 'JOB-END', 'jobId=0|jobResult=JobSucceeded',
         'jobId,0,jobResult,JobSucceeded' FROM app
  UNION ALL SELECT 'event', first_ms // 1000, 'STAGE-SUBMITTED',
         'stageId=' || stage_id || '|name=' || event_type || '|parentStageIds=' ||
         CASE WHEN stage_id > 0 THEN CAST(stage_id - 1 AS VARCHAR) ELSE '' END || '|numTasks=' || n,
         'stageId,' || stage_id || ',name,"' || event_type || '",parentStageIds,' ||
         CASE WHEN stage_id > 0 THEN CAST(stage_id - 1 AS VARCHAR) ELSE '' END || ',numTasks,' || n
         FROM stg
  UNION ALL SELECT 'event', last_ms // 1000, 'STAGE-COMPLETED', 'stageId=' || stage_id || '|reason=succeeded',
         'stageId,' || stage_id || ',reason,succeeded' FROM stg
  UNION ALL SELECT 'event', launch_ms // 1000, 'TASK-START',
         'node=' || node || '|taskId=' || task_id || '|stageId=' || stage_id || '|executor=' || executor ||
         '|taskLocality=' || locality,
         'node,' || node || ',taskId,' || task_id || ',stageId,' || stage_id || ',executor,' || executor ||
         ',taskLocality,' || locality FROM tm
  UNION ALL SELECT 'event', finish_ms // 1000, 'TASK-END',
         'node=' || node || '|taskId=' || task_id || '|taskType=ResultTask|stageId=' || stage_id ||
         '|executor=' || executor || '|status=' || status || '|reason=' || reason,
         'node,' || node || ',taskId,' || task_id || ',taskType,ResultTask,stageId,' || stage_id ||
         ',executor,' || executor || ',' || status || ',reason,' || reason FROM tm
  UNION ALL SELECT 'metric', finish_ms // 1000, 'TASK-END',
         'node=' || node || '|taskId=' || task_id || '|bytesWritten=' || bw || '|memoryBytesSpilled=0' ||
         '|shuffleBytesWritten=' || sbw || '|shuffleWriteTime=' || swt || '|shuffleReadLocalBytesRead=' || loc ||
         '|shuffleReadRemoteBytesRead=' || rem || '|shuffleReadTotalBytesRead=' || (loc + rem),
         'node,' || node || ',taskId,' || task_id || ',bytesWritten,' || bw || ',memoryBytesSpilled,0' ||
         ',shuffleBytesWritten,' || sbw || ',shuffleWriteTime,' || swt || ',shuffleReadLocalBytesRead,' || loc ||
         ',shuffleReadRemoteBytesRead,' || rem || ',shuffleReadTotalBytesRead,' || (loc + rem) FROM tm
  UNION ALL SELECT 'event', end_ms // 1000, 'APPLICATION-END', '', '' FROM app
)"""

RT = "WITH " + RUNTIME
_ROWS = f" SELECT {APP} AS app_id, kind, epoch, event, attrs FROM evt"
_EVENT_NAMES = ["SparkListenerApplicationStart", "SparkListenerEnvironmentUpdate", "SparkListenerExecutorAdded",
                "SparkListenerBlockManagerAdded", "SparkListenerExecutorRemoved", "SparkListenerJobStart",
                "SparkListenerJobEnd", "SparkListenerStageSubmitted", "SparkListenerStageCompleted",
                "SparkListenerTaskStart", "SparkListenerTaskEnd", "SparkListenerApplicationEnd"]
_METRIC_COLS = ("bytesWritten", "memoryBytesSpilled", "shuffleBytesWritten", "shuffleWriteTime",
                "shuffleReadLocalBytesRead", "shuffleReadRemoteBytesRead", "shuffleReadTotalBytesRead")
_METRIC_EXPR = {"bytesWritten": "bw", "memoryBytesSpilled": "0", "shuffleBytesWritten": "sbw",
                "shuffleWriteTime": "swt", "shuffleReadLocalBytesRead": "loc",
                "shuffleReadRemoteBytesRead": "rem", "shuffleReadTotalBytesRead": "loc + rem"}

SQL.update({
    "evt_rows": RT + _ROWS,
    "evt_task_start": RT + " SELECT launch_ms // 1000 AS epoch, node, CAST(task_id AS VARCHAR) AS taskId,"
                           " CAST(stage_id AS VARCHAR) AS stageId, executor, locality AS taskLocality FROM tm",
    "evt_task_end": RT + " SELECT finish_ms // 1000 AS epoch, node, CAST(task_id AS VARCHAR) AS taskId,"
                         " 'ResultTask' AS taskType, CAST(stage_id AS VARCHAR) AS stageId, executor, status,"
                         " reason FROM tm",
    "evt_task_metrics": RT + " SELECT finish_ms // 1000 AS epoch, node, CAST(task_id AS VARCHAR) AS taskId, " +
                        ", ".join(f"CAST({_METRIC_EXPR[c]} AS VARCHAR) AS {c}" for c in _METRIC_COLS) + " FROM tm",
    "evt_stage": RT + _ROWS + " WHERE event LIKE 'STAGE-%'",
    "evt_job": RT + _ROWS + " WHERE event LIKE 'JOB-%'",
    "evt_executor": RT + _ROWS + " WHERE event LIKE 'EXECUTOR-%' OR event LIKE 'BLOCK-MANAGER-%'",
    "evt_block": RT + _ROWS + " WHERE event LIKE 'BLOCK-UDPATED%'",
    "evt_app": RT + _ROWS + " WHERE event LIKE 'APPLICATION-%'",
    "listener_lines": RT + f" SELECT {APP} AS app_id, kind || ',' || epoch || ',' || event ||"
                           " CASE WHEN csv = '' THEN '' ELSE ',' || csv END AS line FROM evt",
    "listener_parse": RT + " SELECT kind, epoch, event, attrs FROM evt",
    "durations": RT + f""" SELECT {APP} AS app_id, 'app' AS scope, {APP} AS id,
          end_ms // 1000 - start_ms // 1000 AS elapsed FROM app
        UNION ALL SELECT {APP}, 'job', '0', end_ms // 1000 - start_ms // 1000 FROM app
        UNION ALL SELECT {APP}, 'stage', CAST(stage_id AS VARCHAR), last_ms // 1000 - first_ms // 1000 FROM stg
        UNION ALL SELECT {APP}, 'task', CAST(task_id AS VARCHAR), finish_ms // 1000 - launch_ms // 1000
          FROM tasks""",
    "stage_totals": RT + f" SELECT {APP} AS app_id, stage_id AS stageId, count(*) AS tasks, " + ", ".join(
        f"CAST(sum({_METRIC_EXPR[c]}) AS BIGINT) AS {c}" for c in _METRIC_COLS) + " FROM tm GROUP BY stage_id",
    "node_totals": RT + f" SELECT {APP} AS app_id, node, count(*) AS tasks, " + ", ".join(
        f"CAST(sum({_METRIC_EXPR[c]}) AS BIGINT) AS {c}" for c in _METRIC_COLS) + " FROM tm GROUP BY node",
    "run_summary": RT + f" SELECT {APP} AS app_id, (end_ms - start_ms) // 1000 AS elapsed, '64' AS partitions,"
                        " '8' AS executors, '1g' AS memory, '1' AS cores FROM app",
    "log_app_id": f"SELECT {APP} AS app_id",
    "log_event_types": "SELECT * FROM (VALUES " + ", ".join(f"('{e}')" for e in _EVENT_NAMES) + ") AS t(Event)",
    "log_executor_adds": RT + " SELECT host AS Host, first_ms AS Timestamp FROM hosts",
    "log_executor_lines": RT + " SELECT host || ', @' || first_ms AS line FROM hosts",
})


# --- H: dynamic network ----------------------------------------------------------------

SPELLS = r"""
sp_ev AS (SELECT event_id, event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
sp_stg AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS stage_id
           FROM (SELECT DISTINCT event_type FROM events)),
sp_t AS (
  SELECT CAST(floor((sec - (SELECT min(sec) FROM sp_ev)) / 3600) AS BIGINT) AS onset, event_id,
         'T' || event_id AS task, 'n' || (user_id % 8) AS node, 'S' || s.stage_id AS stage, s.stage_id,
         e.event_type, ['PROCESS_LOCAL', 'NODE_LOCAL', 'RACK_LOCAL', 'ANY'][event_id % 4 + 1] AS locality
  FROM sp_ev e JOIN sp_stg s ON e.event_type = s.event_type
),
t2 AS (SELECT *, onset + event_id % 7 AS terminus FROM sp_t),
vs AS (
  SELECT min(onset) AS onset, max(terminus) AS terminus, node AS vertex_id, node AS name, 'worker' AS type,
         'events replay' AS info, CAST(substr(node, 2) AS BIGINT) AS ord FROM t2 GROUP BY node
  UNION ALL SELECT 0, max(terminus), 'data', 'datasets', 'data', '', 1000000000 FROM t2
  UNION ALL SELECT min(onset), max(terminus), stage, stage, 'stage', event_type, 2000000000 + stage_id
            FROM t2 GROUP BY stage, stage_id, event_type
  UNION ALL SELECT onset, terminus, task, task, 'task', locality, 3000000000 + event_id FROM t2
),
es AS (
  SELECT onset, terminus, task AS tail, node AS head, 'taskToNode' AS type FROM t2
  UNION ALL SELECT onset, terminus, task, 'data', 'taskToData' FROM t2
  UNION ALL SELECT onset, terminus, task, stage, 'taskToStage' FROM t2
),
hz AS (SELECT max(terminus) AS horizon FROM vs),
sl AS (SELECT unnest(range(0, (SELECT horizon FROM hz) + 1, 2)) AS slice),
tv AS (
  SELECT *, CASE WHEN type = 'task' THEN (CASE info WHEN 'PROCESS_LOCAL' THEN 'taskLocal'
              WHEN 'NODE_LOCAL' THEN 'taskNode' WHEN 'RACK_LOCAL' THEN 'taskRack' END) ELSE type END AS vclass
  FROM vs
),
av AS (
  SELECT sl.slice, vs.vertex_id FROM vs JOIN sl
    ON (vs.onset < sl.slice + 2 AND vs.terminus > sl.slice)
    OR (vs.onset = vs.terminus AND sl.slice <= vs.onset AND vs.onset < sl.slice + 2)
)"""

SP = "WITH " + SPELLS
_VATTRS = ("(VALUES ('worker', 4.0::DOUBLE, 32, 'lightgrey', 'black', 0.8::DOUBLE), "
           "('data', 0.1, 32, '#FFFFFF00', '#FFFFFF00', 0.9), ('taskLocal', 1.0, 3, '#90EE9080', 'black', 0.1), "
           "('taskNode', 1.0, 3, '#ADD8E680', 'black', 0.1), ('taskRack', 1.0, 3, '#FF000080', 'black', 0.1), "
           "('stage', 4.0, 6, 'yellow', 'black', 1.0)) AS a(vclass, size, sides, colour, border, label_size)")

SQL.update({
    "spell_horizon": SP + " SELECT horizon FROM hz",
    "spell_labels": SP + " SELECT vertex_id, CASE WHEN type = 'data' THEN '' WHEN type = 'stage'"
                         " THEN name || ' ' || info ELSE name END AS label FROM vs",
    "spell_title": SP + " SELECT arg_min(info, ord) AS title FROM vs",
    "spell_types": SP + " SELECT vertex_id, vclass FROM tv",
    "vertex_attrs": SP + " SELECT vertex_id, tv.vclass, size, sides, colour, border, label_size FROM tv"
                         " LEFT JOIN " + _VATTRS + " ON tv.vclass = a.vclass",
    "edge_attrs": SP + " SELECT tail, head, es.type, colour FROM es LEFT JOIN (VALUES ('taskToNode', 'lightgrey'),"
                       " ('taskToData', '#FFFFFF00'), ('taskToStage', 'yellow')) AS a(type, colour)"
                       " ON es.type = a.type",
    "slices": SP + " SELECT slice FROM sl",
    "active_vertices": SP + " SELECT slice, vertex_id FROM av",
    "active_edges": SP + """, act AS MATERIALIZED (SELECT DISTINCT slice, vertex_id FROM av),
        e2 AS MATERIALIZED (SELECT sl.slice, es.tail, es.head, es.type FROM es JOIN sl
        ON (es.onset < sl.slice + 2 AND es.terminus > sl.slice)
        OR (es.onset = es.terminus AND sl.slice <= es.onset AND es.onset < sl.slice + 2))
        SELECT slice, tail, head, type FROM e2 WHERE (slice, tail) IN (SELECT slice, vertex_id FROM act)
          AND (slice, head) IN (SELECT slice, vertex_id FROM act)""",
    "active_class_runs": SP + """, c AS (SELECT slice, coalesce(vclass, 'other') AS vclass, count(*) AS active
          FROM av JOIN tv ON av.vertex_id = tv.vertex_id GROUP BY 1, 2)
        SELECT vclass, min(slice) AS first_slice, max(slice) AS last_slice, active FROM (
          SELECT *, slice // 2 - row_number() OVER (PARTITION BY vclass, active ORDER BY slice) AS k FROM c)
        GROUP BY vclass, active, k""",
    "active_vertex_runs": SP + """, c AS (SELECT slice, vertex_id, count(*) AS active FROM av GROUP BY 1, 2)
        SELECT vertex_id, min(slice) AS first_slice, max(slice) AS last_slice, active FROM (
          SELECT *, slice // 2 - row_number() OVER (PARTITION BY vertex_id, active ORDER BY slice) AS k FROM c)
        GROUP BY vertex_id, active, k""",
    "latest_attr": SP + """, attr_sl AS (
        SELECT sl.slice, t2.node AS vertex_id, t2.locality AS value,
               row_number() OVER (PARTITION BY t2.node, sl.slice ORDER BY t2.onset DESC, t2.task DESC) AS rn
        FROM t2 JOIN sl ON (t2.onset < sl.slice + 2 AND t2.terminus > sl.slice)
          OR (t2.onset = t2.terminus AND sl.slice <= t2.onset AND t2.onset < sl.slice + 2))
        SELECT vertex_id, slice, value FROM attr_sl WHERE rn = 1""",
    "spell_build": RT + f""", t0 AS (SELECT start_ms // 1000 AS t0 FROM app)
        SELECT {APP} AS app_id, launch_ms // 1000 - (SELECT t0 FROM t0) AS onset,
               finish_ms // 1000 - (SELECT t0 FROM t0) AS terminus, 'T' || task_id AS vertex_id,
               'task' AS type, locality AS info FROM tasks
        UNION ALL SELECT {APP}, first_ms // 1000 - (SELECT t0 FROM t0), last_ms // 1000 - (SELECT t0 FROM t0),
               'S' || stage_id, 'stage', event_type FROM stg
        UNION ALL SELECT {APP}, first_ms // 1000 - (SELECT t0 FROM t0), last_ms // 1000 - (SELECT t0 FROM t0),
               split_part(host, '.', 1), 'worker', executor FROM hosts
        UNION ALL SELECT {APP}, 0, end_ms // 1000 - (SELECT t0 FROM t0), 'data', 'data', '' FROM app""",
    "spell_build_edges": RT + f""", t0 AS (SELECT start_ms // 1000 AS t0 FROM app)
        SELECT {APP} AS app_id, launch_ms // 1000 - (SELECT t0 FROM t0) AS onset,
               finish_ms // 1000 - (SELECT t0 FROM t0) AS terminus, 'T' || task_id AS tail, head, type
        FROM (SELECT *, unnest([split_part(host, '.', 1), 'data', 'S' || stage_id]) AS head,
                     unnest(['taskToNode', 'taskToData', 'taskToStage']) AS type FROM tasks)""",
})


# --- C: metric-sink collation, and the streaming jobs --------------------------------------

SINK = r"""
sink_rows AS (
  SELECT CAST(user_id % 4 AS VARCHAR) AS executor, 'jvm_' || event_type || '_used' AS metric,
         CAST(floor(epoch(ts)) AS BIGINT) AS epoch, value
  FROM events
)"""

SQL.update({
    "sink_collate": "WITH " + SINK + " SELECT 'collector' AS host, executor, metric, 'joe' AS user,"
                    " epoch || ',' || CAST(value AS VARCHAR) AS line FROM sink_rows",
    "sink_long": "WITH " + SINK + " SELECT executor, metric, epoch, 'value' AS field, value FROM sink_rows",
    "stream_collate": "WITH " + SINK + " SELECT 'collector' AS host, executor, metric, 'joe' AS user,"
                      " epoch || ',' || CAST(value AS VARCHAR) AS line FROM sink_rows",
    "stream_events": RT + _ROWS,
    "stream_task_rate": RT + """, ends AS (SELECT finish_ms // 1000 AS epoch, split_part(host, '.', 1) AS node
                                          FROM tasks),
        w AS (SELECT epoch // 3600 * 3600 AS window_start, epoch // 3600 * 3600 + 3600 AS window_end, node
              FROM ends)
        SELECT window_start, window_end, node, count(*) AS tasks FROM w GROUP BY window_start, window_end, node""",
})


SQL["event_marks"] = RT + f""" SELECT {APP} AS app_id, start_ms // 1000 AS epoch, 'global' AS node,
        'APPLICATION-START' AS event, NULL::BIGINT AS seq FROM app
    UNION ALL SELECT {APP}, end_ms // 1000, 'global', 'APPLICATION-END', NULL FROM app
    UNION ALL SELECT {APP}, start_ms // 1000, 'global', 'JOB-START 0', NULL FROM app
    UNION ALL SELECT {APP}, end_ms // 1000, 'global', 'JOB-END 0', NULL FROM app
    UNION ALL SELECT {APP}, first_ms // 1000, 'stage', 'STAGE-SUBMITTED ' || stage_id, stage_id * 2 FROM stg
    UNION ALL SELECT {APP}, last_ms // 1000, 'stage', 'STAGE-COMPLETED ' || stage_id, stage_id * 2 + 1 FROM stg
    UNION ALL SELECT {APP}, first_ms // 1000, split_part(host, '.', 1), 'BLOCK-MANAGER-ADDED', NULL FROM hosts
    UNION ALL SELECT {APP}, first_ms // 1000, split_part(host, '.', 1), 'EXECUTOR-ADDED ' || executor, NULL FROM hosts
    UNION ALL SELECT {APP}, last_ms // 1000, split_part(host, '.', 1), 'EXECUTOR-REMOVED ' || executor, NULL
      FROM hosts"""


# --- file forms, styles and stores: the same rows through a written file ------------------

def _style(edges: str, sizes: tuple, fonts: tuple, colour: str) -> str:
    t = "substr(name, 1, 1) = 'T'"
    return (f"{GRAPH} SELECT name, degree, {t} AS is_task, CASE WHEN {t} THEN {sizes[0]} ELSE {sizes[1]} END AS size,"
            f" CASE WHEN {t} THEN {fonts[0]} ELSE {fonts[1]} END::DOUBLE AS font, CASE WHEN {t} THEN '' ELSE name END"
            f" AS label, {colour} AS colour FROM {edges}")


_SECOND_EDGES = """(SELECT name, count(*) AS degree FROM (SELECT src AS name FROM sec UNION ALL SELECT dst FROM sec) GROUP BY name)"""
SQL.update({
    "vertex_style_nodes": _style(_degree("tn_edges"), (2, 5), (0.1, 0.7), "CASE WHEN degree > 2 THEN 'green' ELSE 'white' END"),
    "vertex_style_seconds": _style(_SECOND_EDGES, (2, 15), (0.1, 0.9),
                                   "CASE WHEN substr(name, 1, 1) = 'T' THEN 'white' ELSE 'green' END").replace(
        GRAPH, GRAPH + ", sec AS (" + SQL["edges_task_second"].replace(GRAPH, "") + ")", 1),
    "edges_from_tsv": SQL["edges_task_stage"],
    "series_from_csv": SQL["series_metrics"],
    "marks_from_csv": SQL["event_split"],
    "moment_columns": SONG + " SELECT hotness AS x, tempo AS y, hotness * tempo AS xy, hotness * hotness AS x2,"
                             " tempo * tempo AS y2 FROM pj",
    "sink_append": f"SELECT *, 'joe_1700000000' AS app_id FROM ({SQL['sink_collate']}) AS c",
    "spells_from_csv": SP + " SELECT onset, terminus, vertex_id, name, type, info FROM vs",
    "edge_spells_from_csv": SP + " SELECT onset, terminus, tail, head, type FROM es",
})

SQL["active_edge_runs"] = """SELECT tail, head, type, min(slice) AS first_slice, max(slice) AS last_slice FROM (
  SELECT *, slice // 2 - row_number() OVER (PARTITION BY tail, head, type ORDER BY slice) AS k FROM ("""  \
    + SQL["active_edges"] + """)) GROUP BY tail, head, type, k"""


SQL["listener_records"] = RT + r""" SELECT kind, epoch, event, replace(attrs, 'reason=ExceptionFailure',
        'reason=java.lang.RuntimeException: k is zero, retry' || chr(10) || chr(9) || 'at work(Replay.scala:12)'
        || chr(10) || chr(10) || 'Caused by: reason,none, "quoted') AS attrs FROM evt"""

RESTARTED = """SELECT CAST(user_id % 4 AS VARCHAR) AS executor, 'jvm_' || event_type || '_used' AS metric, event_id,
        user_id, event_type, value, epoch_us(ts) // 1000000 AS epoch FROM events WHERE event_type IS NOT NULL"""
SQL["sink_long_headers"] = f"""WITH r AS ({RESTARTED})
    SELECT executor, metric, epoch, 'value' AS field, value FROM r WHERE event_id % 97 <> 0
    UNION ALL SELECT executor, metric, epoch, 'user', CAST(user_id AS DOUBLE) FROM r
    WHERE event_id % 97 <> 0 AND epoch // 86400 % 2 = 1"""
SQL["sink_misfits"] = f"""WITH r AS ({RESTARTED})
    SELECT 'joe_1700000000.' || executor || '.jvm.' || event_type || '.used.csv' AS sink,
           CAST(epoch AS VARCHAR) AS line FROM r WHERE event_id % 97 = 0"""

SQL["stream_busy_sessions"] = RT + """, ends AS (SELECT finish_ms // 1000 AS epoch, split_part(host, '.', 1) AS node
                                                 FROM tasks),
    g AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY node ORDER BY epoch) < 600 THEN 0 ELSE 1 END AS fresh
          FROM ends),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY node ORDER BY epoch) AS run FROM g)
    SELECT min(epoch) AS window_start, max(epoch) + 600 AS window_end, node, count(*) AS tasks FROM s GROUP BY node, run"""
SQL["stream_durations"] = SQL["durations"]
SQL["stream_slow_tasks"] = RT + f""" SELECT {APP} AS app_id, 'task' AS scope, CAST(task_id AS VARCHAR) AS id,
    launch_ms // 1000 AS start, CASE WHEN finish_ms // 1000 - launch_ms // 1000 <= 60
                                     THEN finish_ms // 1000 - launch_ms // 1000 END AS elapsed FROM tasks"""


# --- states that merge, several applications, redelivered files ------------------------

SQL["corr_moments"] = SONG + f" SELECT count(*) AS rows, {_sig('corr(hotness, tempo)', 8)} AS r FROM pj"
SQL["corr_moments_by_artist"] = SONG + f""" SELECT artist7Id, count(*) AS n, {_sig('avg(duration)', 8)} AS avg_duration,
    {_sig('corr(duration, tempo)', 8)} AS r FROM tracks GROUP BY artist7Id"""
SOURCE_WORDS = r"""WITH low AS (SELECT lower(text) AS t FROM documents),
words AS (SELECT unnest(CASE WHEN t = '' THEN [''] WHEN regexp_replace(t, '[ .;:()?"]+$', '') = '' THEN []::VARCHAR[]
          ELSE string_split_regex(regexp_replace(t, '[ .;:()?"]+$', ''), '[ .;:()?"]+') END) AS word FROM low)"""
SQL["distinct_words_sketch"] = SOURCE_WORDS + " SELECT count(DISTINCT word) AS distinct_words, true AS within FROM words"
SQL["heavy_words"] = SOURCE_WORDS + """ SELECT word, count(*) AS n FROM words GROUP BY word
    HAVING count(*) * 1000 >= (SELECT count(*) FROM words)"""
SQL["task_time_quantiles"] = GRAPH + """ SELECT stage_id, executor, tasks, q::DOUBLE AS q, true AS within
    FROM (SELECT stage_id, executor, count(*) AS tasks FROM tasks GROUP BY ALL), (VALUES (0.5), (0.95), (0.99)) AS a(q)"""
_APP_OF = "'app-20240101000000-000' || (task_id % 3)"
SQL["log_app_ids"] = GRAPH + f" SELECT DISTINCT {_APP_OF} AS app_id FROM tasks"
SQL["app_summary"] = GRAPH + f""" SELECT {_APP_OF} AS app_id, (max(finish_ms) - min(launch_ms)) // 1000 AS elapsed,
    '64' AS partitions, '8' AS executors, '1g' AS memory, '1' AS cores FROM tasks GROUP BY 1"""
SQL["app_durations"] = GRAPH + f""", a AS (SELECT *, {_APP_OF} AS app_id FROM tasks),
    app AS (SELECT app_id, max(finish_ms) // 1000 - min(launch_ms) // 1000 AS elapsed FROM a GROUP BY app_id)
    SELECT app_id, 'app' AS scope, app_id AS id, elapsed FROM app
    UNION ALL SELECT app_id, 'job', '0', elapsed FROM app
    UNION ALL SELECT app_id, 'stage', CAST(stage_id AS VARCHAR), max(finish_ms) // 1000 - min(launch_ms) // 1000
      FROM a GROUP BY app_id, stage_id
    UNION ALL SELECT app_id, 'task', CAST(task_id AS VARCHAR), finish_ms // 1000 - launch_ms // 1000 FROM a"""
SQL["app_stage_totals"] = RT + f" SELECT {_APP_OF} AS app_id, stage_id AS stageId, count(*) AS tasks, " + ", ".join(
    f"CAST(sum({_METRIC_EXPR[c]}) AS BIGINT) AS {c}" for c in _METRIC_COLS) + " FROM tm GROUP BY 1, stage_id"
SQL["app_node_totals"] = SQL["app_stage_totals"].replace("stage_id AS stageId", "node").replace("1, stage_id", "1, node")
SQL["evt_block_updates"] = GRAPH + f""", b AS (
      SELECT *, 'rdd_' || stage_id || '_' || task_id AS block FROM tasks WHERE has_metrics
      UNION ALL SELECT *, 'broadcast_' || stage_id FROM tasks WHERE task_id % 5 = 0),
    s AS (SELECT *, {_APP_OF} AS app_id, coalesce(bytes_written, 0) * 10 AS size, task_id % 3 = 0 AS disk FROM b)
    SELECT app_id, 'event' AS kind, finish_ms // 1000 AS epoch, 'BLOCK-UDPATED' AS event,
           'node=' || host || '|name=' || block AS attrs FROM s
    UNION ALL SELECT app_id, 'metric', finish_ms // 1000, 'BLOCK-UDPATED',
           'blockId=' || block || '|isRDD=' || (block LIKE 'rdd_%') || '|isShuffle=false|host=' || host || '|diskSize='
           || CASE WHEN disk THEN size ELSE 0 END || '|externalBlockStoreSize=0|memSize=' || size || '|storageLevel='
           || CASE WHEN disk THEN 'Disk Memory' ELSE 'Memory Deserialized' END || ' 1x Replicated' FROM s"""
SQL["stream_collate_once"] = "SELECT DISTINCT * FROM (" + SQL["stream_collate"] + ")"


# --- logs of unknown shape -----------------------------------------------------------------

SQL["log_heap_by_executor"] = GRAPH + """ SELECT executor, count(*) AS updates, max(bytes_written) AS heap
    FROM tasks GROUP BY executor"""
SQL["log_broken_lines"] = GRAPH + """ SELECT '{"Event":"cut' || task_id AS line FROM tasks WHERE task_id % 50 = 0"""
SQL["log_unknown_fields"] = GRAPH + """ SELECT 'SparkListenerExecutorMetricsUpdate' AS event, 'Note' AS field,
      'STRING' AS shape, count(*) AS lines FROM tasks WHERE task_id % 4 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'SparkListenerExecutorMetricsUpdate', 'Metrics Updated',
      'ARRAY<OBJECT<' || CASE WHEN count(bytes_written) > 0 THEN 'Heap: BIGINT, ' ELSE '' END || '`Task ID`: BIGINT>>',
      count(*) FROM tasks HAVING count(*) > 0"""
SQL["log_event_lines"] = RT + """, lines(event, n) AS (
    SELECT 'SparkListenerApplicationStart', 1 UNION ALL SELECT 'SparkListenerEnvironmentUpdate', 1
    UNION ALL SELECT 'SparkListenerApplicationEnd', 1 UNION ALL SELECT 'SparkListenerJobStart', 1
    UNION ALL SELECT 'SparkListenerJobEnd', 1
    UNION ALL SELECT unnest(['SparkListenerExecutorAdded', 'SparkListenerBlockManagerAdded',
                             'SparkListenerExecutorRemoved']), (SELECT count(*) FROM hosts)
    UNION ALL SELECT unnest(['SparkListenerStageSubmitted', 'SparkListenerStageCompleted']), (SELECT count(*) FROM stg)
    UNION ALL SELECT unnest(['SparkListenerTaskStart', 'SparkListenerTaskEnd', 'SparkListenerExecutorMetricsUpdate']),
                     (SELECT count(*) FROM tasks)
    UNION ALL SELECT NULL, (SELECT count(*) FROM tasks WHERE task_id % 50 = 0))
    SELECT event, n AS lines FROM lines WHERE n > 0"""
