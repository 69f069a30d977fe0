"""DataFrame -> DataFrame operators, one module per workload family:

  text      word count, lookup, top-k, grep, character count
  records   song-record parsing and derived features
  stats     pair join, moment sums, Pearson and rank correlation
  sinkfiles metric-sink file collation
  runtime   runtime-event normalisation (jobs, stages, tasks, executors)
  eventlog  SQL over the JSON event log
  series    node time series, event overlays, stage bands
  graph     task graphs: vertices, degree, classes, edge builders
  spells    dynamic network: spells, slices, activity, attributes
"""
