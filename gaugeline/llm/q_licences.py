"""Query of the licence scan, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import licences


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_licences": op10_licences}

_TEMPLATES = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{b}'" for b in licences.bigrams_of(t))) for k, t in licences.TEMPLATES.items())

SQL = {
    "op10_licences": f"""
WITH templates AS (SELECT * FROM (VALUES {_TEMPLATES}) v(licence, pairs)),
units AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(u))) AS number, unnest(u) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents)
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(range(len(u))), unnest(u) FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: contains(trim(p, ' '), chr(10))) AS u FROM documents)
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM documents WHERE regexp_matches(text, '\\n[ \\t]*\\n')),
worded AS (
  SELECT doc_id, kind, number, string_split(trim(regexp_replace(translate(unit, '{licences.UPPER}', '{licences.LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
paired AS (SELECT doc_id, kind, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM worded)
SELECT doc_id, kind, number::INTEGER AS number, licence, len(list_intersect(p.pairs, t.pairs))::INTEGER AS shared, len(p.pairs)::INTEGER AS n_unit, len(t.pairs)::INTEGER AS n_template,
  2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice
FROM paired p JOIN templates t
  ON len(p.pairs) BETWEEN (len(t.pairs) * {licences.LEAST} + {199 - licences.LEAST}) // {200 - licences.LEAST} AND len(t.pairs) * {200 - licences.LEAST} // {licences.LEAST}
WHERE 200 * len(list_intersect(p.pairs, t.pairs)) >= {licences.LEAST} * (len(p.pairs) + len(t.pairs))
""",
}
