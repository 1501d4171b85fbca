"""Query op10: licences of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.licences import ANY_WORD, BREAK, COPYRIGHT_LINE, LAST, LEADER, LICENCE_WORD, NAMED, RULES, SHORT, known_segments, rule_pattern, scan_licences, slot_patterns


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences")]
    return found.select("doc_id", F.size("sentence_ids").alias("n_sentences"), *joined)


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_segments()
    slots = slot_patterns()
    marked = "'  ' || replace(s, ' ', '  ') || '  '"
    for i, (pattern, _) in enumerate(slots):
        marked = f"regexp_replace({marked}, {quote(pattern)}, ' #{len(known) + i}# ', 'g')"
    for i, (k, _) in enumerate(known):
        marked = f"replace({marked}, {quote(f' {k} '.replace(' ', '  ')[1:-1])}, ' #{i}# ')"
    names = "[" + ", ".join(quote(n) for _, n in [*known, *slots]) + "]"
    steps, cols = "SELECT doc_id, ids, list_reduce(list_transform(list_filter(ids, lambda x, i: x <> 'UNKNOWN' OR i = 1 OR ids[i - 1] <> 'UNKNOWN'), lambda s: '|' || s || '|'), lambda a, b: a || b, '') AS line FROM named", []
    for k, (name, seq) in enumerate(RULES):
        pattern = quote(rule_pattern(seq))
        steps = f"SELECT * REPLACE (regexp_replace(line, {pattern}, '#', 'g') AS line), CASE WHEN regexp_matches(line, {pattern}) THEN {quote(name)} END AS r{k} FROM ({steps})"
        cols.append(f"r{k}")
    return rf"""
WITH lowered AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\r\n?', chr(10), 'g') AS t FROM documents),
parts AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{ANY_WORD}') THEN regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(t, '{LEADER}', '', 'g'), '{SHORT}', 'v \1', 'g'), '{NAMED}', '\1\2\3\4', 'g'), '{BREAK}') ELSE [] END AS p FROM lowered),
clean AS (SELECT doc_id, list_filter(list_transform(p, lambda s: trim(regexp_replace(regexp_replace(s, '\b(19|20)[0-9][0-9]\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))), lambda s: regexp_matches(s, '{LICENCE_WORD}')) AS p FROM parts),
one AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM clean),
marked AS (SELECT doc_id, i, s, {marked} AS m FROM one),
told AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '{COPYRIGHT_LINE}') AND NOT regexp_matches(s, 'licen|permi') THEN ['COPYRIGHT'] ELSE list_concat(list_filter(list_transform(regexp_extract_all(m, '#([0-9]+)#', 1), lambda k: {names}[cast(k AS INTEGER) + 1]), lambda x: x <> ''), CASE WHEN regexp_matches(m, '{LICENCE_WORD}') THEN ['UNKNOWN'] ELSE [] END) END AS ids FROM marked),
named AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM told GROUP BY doc_id),
fired AS ({steps}),
fits AS (SELECT doc_id, ids, list_filter([{", ".join(cols)}], lambda s: s IS NOT NULL) AS l FROM fired),
found AS (SELECT doc_id, ids, list_filter(l, lambda s: s <> '{LAST}' OR len(list_filter(l, lambda x: x NOT IN ('{LAST}', 'Unknown'))) = 0) AS l FROM fits)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS INTEGER) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
coalesce(array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i), ','), '') AS licences FROM documents LEFT JOIN found USING (doc_id)"""


QUERIES = {"op10_licences": op10_licences}
ORACLE_SQL = {"op10_licences": _sql()}
