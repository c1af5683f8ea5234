"""Problem 7 as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import drift
from quillon.plans.registry import query
from quillon.plans.runtime import table


@query()
def p7_found(spark, d):
    return drift.schema_changes(table(spark, d, "raw_records"))


@query()
def p7_records(spark, d):
    return drift.ingest(table(spark, d, "raw_records"))


FIELDS = """
b AS (SELECT stream_id, file_no, b FROM (SELECT stream_id, file_no, CASE WHEN json_valid(body) THEN body END::JSON AS b FROM raw_records) WHERE json_type(b) = 'OBJECT'),
k AS (SELECT stream_id, file_no, unnest(json_keys(b)) AS f, b FROM b), t AS (SELECT stream_id, file_no, f AS field, json_type(b, '$."' || f || '"') AS t FROM k WHERE f <> 'detail'),
x AS (SELECT stream_id, file_no, json_extract(b, '$.detail') AS b FROM b WHERE json_type(b, '$.detail') = 'OBJECT'), y AS (SELECT stream_id, file_no, unnest(json_keys(b)) AS f, b FROM x),
a AS (SELECT * FROM t UNION ALL SELECT stream_id, file_no, 'detail.' || f, json_type(b, '$."' || f || '"') FROM y),
n AS (SELECT stream_id, file_no, field, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'fraction' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'whole' END AS kind FROM a)"""


@query(f"WITH {FIELDS} SELECT stream_id, file_no, field, coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind), '') AS kinds FROM n GROUP BY ALL")
def p7_fields(spark, d):
    """The fields of every file with the kinds of their values, from the enforced records."""
    return drift.field_kinds(drift.enforce(table(spark, d, "raw_records")))


@query("SELECT stream_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END) AS n_valid FROM raw_records GROUP BY 1")
def p7_validity(spark, d):
    return drift.enforce(table(spark, d, "raw_records")).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))
