"""The registered queries over the test tables, each beside its DuckDB SQL where SQL can say it."""

from loomgraph.plans import corpus_queries, graph_queries, layout_queries, setting_queries, stream_queries

_PARTS = (corpus_queries, graph_queries, layout_queries, setting_queries, stream_queries)

QUERIES = {name: query for part in _PARTS for name, (query, _) in part.CATALOG.items()}
ORACLES = {name: sql for part in _PARTS for name, (_, sql) in part.CATALOG.items() if sql}
