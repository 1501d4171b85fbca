"""All queries of this subpackage, and the SQL of those that SQL can express."""

from grainfield.llm import bpe_query, chat_format_query, chat_repair_query, dac_query, flac_query, html_query, licences_query, mixing_query, permuterm_query, rabitq_query, simhash_query, toxicity_query, url_query

_MODULES = [bpe_query, dac_query, url_query, mixing_query, simhash_query, html_query, flac_query, rabitq_query, toxicity_query, licences_query, chat_repair_query, chat_format_query, permuterm_query]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
