"""Query of mixing to target weights, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import mixing

#: Target weights: one of the sources is to give a sixth of the mixture, four a twelfth each, the others together the rest.
WEIGHTS = {"src0": 24} | {f"src{i}": 12 for i in range(1, 5)} | {f"src{i}": 4 for i in range(5, 20)}
OTHER = 12


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixing.mixed(docs, WEIGHTS, OTHER).select("doc_id", "source", "block", "slot", "place")


QUERIES = {"op1_mixing": op1_mixing}

_WEIGHTS = ", ".join(f"('{k}', {v}::BIGINT)" for k, v in sorted({**WEIGHTS, "~other": OTHER}.items()))

SQL = {
    "op1_mixing": f"""
WITH RECURSIVE weights AS (SELECT * FROM (VALUES {_WEIGHTS}) v(pool, w)),
named AS (
  SELECT d.doc_id, d.source, coalesce(k.pool, '~other') AS pool, coalesce(md5('0:' || d.doc_id::VARCHAR), repeat('0', 32)) AS h
  FROM documents d LEFT JOIN weights k ON d.source = k.pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h, doc_id) - 1 AS r FROM named),
pools AS (
  SELECT k.pool, k.w, (n + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks, row_number() OVER (ORDER BY CASE WHEN k.pool = '~other' THEN '' ELSE k.pool END) AS i
  FROM weights k JOIN (SELECT pool, count(*) AS n FROM ranked GROUP BY pool) c USING (pool)),
rounds AS (
  SELECT q, list(greatest(least(w, blocks - q * w), 0) ORDER BY i) AS ms, sum(greatest(least(w, blocks - q * w), 0))::BIGINT AS len, sum(least(blocks, q * w))::BIGINT AS base
  FROM pools, (SELECT unnest(range(0, (SELECT max((blocks + w - 1) // w) FROM pools))) AS q) GROUP BY q),
sim AS (
  SELECT q, 0::BIGINT AS t, list_transform(ms, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, ms, len FROM rounds
  UNION ALL
  SELECT q, t + 1, list_transform(done, lambda d, i: CASE WHEN i = pk THEN d + 1 ELSE d END), pk, ms, len
  FROM (SELECT *, list_min(list_filter(list_transform(range(1, len(ms) + 1), lambda i:
          CASE WHEN done[i] < ms[i] AND (done[i] * len) // ms[i] <= t THEN (((done[i] + 1) * len + ms[i] - 1) // ms[i]) * 1000 + i END), lambda x: x IS NOT NULL)) % 1000 AS pk
        FROM sim WHERE t < len))
SELECT r.doc_id, r.source, r.r // {mixing.BLOCK} AS block, n.base + s.t - 1 AS slot, (r.r % {mixing.BLOCK})::INTEGER AS place
FROM ranked r JOIN pools p USING (pool)
JOIN sim s ON s.pick = p.i AND s.q = (r.r // {mixing.BLOCK}) // p.w AND s.done[s.pick] - 1 = (r.r // {mixing.BLOCK}) % p.w
JOIN rounds n ON n.q = s.q
""",
}
