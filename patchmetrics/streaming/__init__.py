"""Streaming: intentionally empty.

The analysed pipeline has no streams, watermarks, windows over time, sessions or state; its only incremental
artefact is the append-only audit log, which is a batch append (``sources.io.append_audit_log``). No streaming
operator is invented here. A caller who wants the KPI report to follow a growing log can point
``spark.readStream.schema(AUDIT_LOG_DDL).json(dir)`` at the log folder and run ``operators.report`` functions in
``foreachBatch``; every section is an aggregate and works per micro-batch over the full table read.
"""
