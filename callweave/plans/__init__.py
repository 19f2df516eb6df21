"""Whole jobs: the enrichment of calls, and the named queries."""
