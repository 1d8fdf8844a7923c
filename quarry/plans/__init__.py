"""Registered queries of the record, retrieval, graph, metric, corpus and operation jobs."""

from . import corpus, graph, ingest, metrics, records, retrieval
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "graph", "ingest", "metrics", "records", "retrieval"]
