"""Structured Streaming jobs: continuous sink-file collation and live
runtime-event ingestion with a watermarked task rate. Each job appends to a
file sink with a checkpoint in the shared folder, so a restarted job resumes
exactly where it stopped."""
