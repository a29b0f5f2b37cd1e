"""Trace analytics on Spark: spans, coverage rules, delegation graphs, sessions, logs and text scans as DataFrame plans."""
