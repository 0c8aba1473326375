"""The registered queries and their SQL oracles."""

from . import analytics, clusters, graphs, memory, streams, surface, tables, traces, vectors

MODULES = [vectors, analytics, traces, graphs, clusters, memory, tables, streams, surface]
ALL_QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ALL_ORACLES = {k: f for m in MODULES for k, f in m.ORACLES.items()}
