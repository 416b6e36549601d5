"""All core queries and their SQL, by name."""

from quillgraph.plans import browse_queries, data_queries, edge_queries, graph_oracles, graph_queries

_PARTS = (data_queries, browse_queries, graph_queries, edge_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in (data_queries, browse_queries, graph_oracles, edge_queries) for k, v in p.ORACLES.items()}
