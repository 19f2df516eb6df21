"""Typed scans, derived input tables, segment manifests, chunk streams and sinks."""
