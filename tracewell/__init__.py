"""Tracewell: analytics over recorded agent sessions, on PySpark."""
