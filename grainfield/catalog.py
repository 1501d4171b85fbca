"""Every registered query of the reference's operators, with its SQL."""

from grainfield.plans import board_queries, corpus_queries, crawl_queries, eval_queries, page_queries

_MODULES = [board_queries, page_queries, corpus_queries, crawl_queries, eval_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
