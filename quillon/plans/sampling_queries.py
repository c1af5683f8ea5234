"""Draws, splits, custody and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import natural_key
from quillon.operators import sampling as S
from quillon.operators import sets as U
from quillon.plans.registry import query
from quillon.plans.runtime import table

ITEMS = "SELECT DISTINCT dataset, item_id, dataset || '|' || item_id AS id FROM result_items"
KEY = "sha256('{seed}:' || {id})"


def items(spark, d):
    return table(spark, d, "result_items").select("dataset", "item_id", F.concat_ws("|", "dataset", "item_id").alias("id")).distinct()


@query(f"SELECT id FROM ({ITEMS}) ORDER BY {KEY.format(seed=20, id='id')}, id LIMIT 100")
def sample_items_n(spark, d):
    return S.sample_n(items(spark, d).select("id"), "id", 100, 20)


@query()
def permutation_head(spark, d):
    return S.permutation_sample(items(spark, d), "id", 100, 20260711)


@query(f"""
WITH i AS ({ITEMS}), s AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS k, count(*) OVER () AS l FROM (SELECT DISTINCT dataset FROM i)),
r AS (SELECT i.dataset, item_id, row_number() OVER (PARTITION BY i.dataset ORDER BY {KEY.format(seed=7, id='item_id')}, item_id) AS place FROM i)
SELECT r.dataset, item_id, place::INT AS place FROM r JOIN s USING (dataset) WHERE place <= 50 // l + CASE WHEN k < 50 % l THEN 1 ELSE 0 END""")
def stratified_quota(spark, d):
    return S.stratified_quota(items(spark, d).select("dataset", "item_id"), "item_id", "dataset", 50, 7)


@query(f"""
WITH i AS (SELECT DISTINCT id FROM ({ITEMS})), t AS (SELECT id FROM i ORDER BY {KEY.format(seed=1020, id='id')}, id LIMIT 60),
d AS (SELECT id FROM i WHERE id NOT IN (SELECT id FROM t) ORDER BY {KEY.format(seed=20, id='id')}, id LIMIT 40)
SELECT id, 'test' AS split FROM t UNION ALL SELECT id, 'dev' FROM d""")
def disjoint_draw(spark, d):
    return S.disjoint_draw(items(spark, d), "id", 60, 40, 1020, 20)


GROUPED = """
i AS (SELECT dataset || '|' || item_id AS id, min(group_id) AS g FROM result_items GROUP BY ALL),
k AS (SELECT id, coalesce(g, '__single__' || id) AS g FROM i),
s AS (SELECT g, count(*) AS size FROM k GROUP BY g),
t AS (SELECT g FROM (SELECT g, coalesce(sum(size) OVER (ORDER BY sha256('42:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) WHERE b < 60),
v AS (SELECT g FROM (SELECT g, coalesce(sum(size) OVER (ORDER BY sha256('43:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WHERE g NOT IN (SELECT g FROM t)) WHERE b < 40),
c AS (SELECT g, 'test' AS split FROM t UNION ALL SELECT g, 'dev' FROM v)"""


def _grouped(spark, d):
    i = table(spark, d, "result_items").groupBy("dataset", "item_id").agg(F.min("group_id").alias("grp")).select(F.concat_ws("|", "dataset", "item_id").alias("id"), "grp")
    return S.group_disjoint_draw(i, "id", F.col("grp"), 60, 40, 42)


@query(f"WITH {GROUPED} SELECT id, g, split FROM k JOIN c USING (g)")
def group_disjoint_split(spark, d):
    return _grouped(spark, d)


@query(f"""WITH {GROUPED}, p AS (SELECT split, g, count(*) AS n FROM k JOIN c USING (g) GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS n_items, count(*) AS n_groups, max(n) AS largest_group, (sum(n) - CASE WHEN split = 'test' THEN 60 ELSE 40 END)::BIGINT AS overshoot FROM p GROUP BY split""")
def group_split_summary(spark, d):
    return S.draw_summary(_grouped(spark, d), 60, 40)


@query("SELECT dataset, count(DISTINCT item_id) AS n_ids, sha256(string_agg(item_id, chr(10) ORDER BY item_id)) AS ids_sha256 FROM (SELECT DISTINCT dataset, item_id FROM result_items) GROUP BY dataset")
def id_set_hash(spark, d):
    return S.set_hash(table(spark, d, "result_items"), ["dataset"], "item_id")


DIGITS = ", ".join(f"sum(('0x' || substr(md5(item_id), {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))


@query(f"SELECT dataset, count(*) AS n_ids, sha256(concat_ws('|', count(*)::VARCHAR, {DIGITS})) AS digest FROM (SELECT DISTINCT dataset, item_id FROM result_items WHERE item_id IS NOT NULL) GROUP BY dataset")
def id_set_digest(spark, d):
    return S.set_digest(table(spark, d, "result_items"), ["dataset"], "item_id")


@query("""
WITH r AS (SELECT DISTINCT dataset, split, item_id FROM result_items)
SELECT a.dataset, count(*) AS n_test, count(b.item_id) AS n_overlap, round(count(b.item_id) / count(*), 4) AS overlap_fraction
FROM (SELECT * FROM r WHERE split = 'test') a LEFT JOIN (SELECT * FROM r WHERE split = 'dev') b USING (dataset, item_id) GROUP BY a.dataset""")
def exposure_overlap(spark, d):
    r = table(spark, d, "result_items")
    return S.exposure(r.where("split = 'test'"), r.where("split = 'dev'"), ["dataset"], "item_id")


@query("SELECT DISTINCT dataset || '|' || item_id AS id FROM result_items GROUP BY dataset, item_id HAVING count(group_id) = 0 OR max(trim(group_id)) = ''")
def coverage_gaps(spark, d):
    r = table(spark, d, "result_items").withColumn("id", F.concat_ws("|", "dataset", "item_id"))
    return S.check_coverage(r, "id", r.where("group_id is not null").groupBy("id").agg(F.max("group_id").alias("g")), "g")


@query("SELECT dataset || '|' || item_id AS id, count(DISTINCT group_id) AS n_groups FROM result_items GROUP BY dataset, item_id HAVING count(DISTINCT group_id) > 1")
def group_conflicts(spark, d):
    return S.conflicting_groups(table(spark, d, "result_items").withColumn("id", F.concat_ws("|", "dataset", "item_id")), "id", "group_id")


@query("""
SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source, lang) * 0.8)) THEN 'head' ELSE 'tail' END AS part
FROM documents""")
def tail_split(spark, d):
    return S.tail_split(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).drop("lang")


@query("""
WITH g AS (SELECT group_id FROM result_items WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 8),
c AS (SELECT group_id FROM g ORDER BY sha256('5:' || group_id), group_id LIMIT 10)
SELECT group_id, row_id, position::INT AS position FROM (SELECT group_id, row_id,
 row_number() OVER (PARTITION BY group_id ORDER BY coalesce(try_cast(nullif(regexp_extract(item_id, '([0-9]+)$', 1), '') AS BIGINT), -1), item_id, row_id) AS position
 FROM result_items WHERE group_id IN (SELECT group_id FROM c)) WHERE position <= 8""")
def depth_cohort(spark, d):
    return S.cohort(table(spark, d, "result_items").select("group_id", "row_id", "item_id"), "group_id", [natural_key(F.col("item_id")), F.col("row_id")], 10, 8, 5).select("group_id", "row_id", "position")


@query("""
SELECT dataset, item_id, CASE WHEN dataset = 'voicebench-bbh' THEN regexp_replace(item_id, '_[^_]*$', '') WHEN dataset = 'vocalbench-zh' THEN NULL
 WHEN dataset LIKE 'speech-massive%' THEN group_id WHEN dataset = 'heysquad' THEN left(sha1(instr), 16) END AS key, count(*) AS n FROM result_items GROUP BY ALL""")
def group_keys(spark, d):
    r = table(spark, d, "result_items")
    return r.select("dataset", "item_id", S.group_key(F.col("dataset"), F.col("item_id"), {"scenario_str": F.col("group_id"), "context": F.col("instr")}).alias("key")).groupBy("dataset", "item_id", "key").agg(F.count("*").alias("n"))


@query("SELECT row_id, (3 * 100003 + cell_id * 17 + row_id % 8)::BIGINT AS seed FROM result_items")
def item_seeds(spark, d):
    return table(spark, d, "result_items").select("row_id", S.item_seed(F.lit(3), F.col("cell_id"), F.col("row_id") % 8).alias("seed"))


# -- set operations --------------------------------------------------------------------------------------------------


@query("SELECT card_id, kid FROM (SELECT card_id, kid, row_number() OVER (PARTITION BY source_tag, content ORDER BY card_id) AS n FROM knowledge_cards) WHERE n = 1")
def dedup_first(spark, d):
    return U.first_of(table(spark, d, "knowledge_cards"), ["source_tag", "content"], ["card_id"]).select("card_id", "kid")


@query("SELECT card_id, kid, (row_number() OVER (PARTITION BY kid ORDER BY card_id) - 1)::INT AS dup_id FROM knowledge_cards")
def dup_numbering(spark, d):
    return U.number_copies(table(spark, d, "knowledge_cards").select("card_id", "kid"), ["kid"], ["card_id"])


@query("""
WITH a AS (SELECT DISTINCT dataset, item_id FROM result_items WHERE backbone = 'meralion-2-gguf'), b AS (SELECT DISTINCT dataset, item_id FROM result_items WHERE backbone = 'qwen3-omni-30b-gguf'),
f AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, a.item_id AS x, b.item_id AS y FROM a FULL JOIN b USING (dataset, item_id))
SELECT dataset, count(*) FILTER (WHERE y IS NULL) AS missing, count(*) FILTER (WHERE x IS NULL) AS extra, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS common FROM f GROUP BY 1""")
def id_set_difference(spark, d):
    r = table(spark, d, "result_items")
    return U.set_difference(r.where("backbone = 'meralion-2-gguf'"), r.where("backbone = 'qwen3-omni-30b-gguf'"), ["dataset"], "item_id")


@query("""
WITH e AS (SELECT DISTINCT dataset, item_id FROM eval_items), m AS (SELECT DISTINCT backbone, dataset, item_id FROM result_items)
SELECT backbone, count(*) AS n_ids, count(e.item_id) AS n_common FROM m LEFT JOIN e USING (dataset, item_id) GROUP BY backbone""")
def prior_intersections(spark, d):
    m = table(spark, d, "result_items").withColumn("id", F.concat_ws("|", "dataset", "item_id"))
    e = table(spark, d, "eval_items").withColumn("id", F.concat_ws("|", "dataset", "item_id"))
    return U.intersections(e, m, "backbone", "id")


@query("""
WITH a AS (SELECT row_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(reply, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS x,
 list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(detail.gold, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS y FROM result_items)
SELECT row_id, len(list_intersect(x, y))::INT AS n_common, (len(x) + len(y) - len(list_intersect(x, y)))::INT AS n_all,
 CASE WHEN len(x) + len(y) = 0 THEN NULL ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) END AS jaccard FROM a""")
def token_jaccard(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda x: x != ""))
    r = table(spark, d, "result_items").select("row_id", words(F.col("reply")).alias("x"), words(F.col("detail.gold")).alias("y"))
    return U.jaccard(r, "x", "y").select("row_id", "n_common", "n_all", F.round("jaccard", 6).alias("jaccard"))


@query("""
WITH u AS (SELECT text AS t, 'documents' AS part, lang AS k FROM documents UNION ALL SELECT content, 'knowledge_cards', source FROM knowledge_cards UNION ALL SELECT question, 'eval_items', dataset FROM eval_items)
SELECT part, count(*) AS n, count(t) AS n_texts, count(DISTINCT t) AS n_distinct FROM u GROUP BY part""")
def union_of_texts(spark, d):
    parts = {"documents": ("text", "lang"), "knowledge_cards": ("content", "source"), "eval_items": ("question", "dataset")}
    u = U.union_all([table(spark, d, n).select(F.col(t).alias("t"), F.lit(n).alias("part"), F.col(k).alias("k")) for n, (t, k) in parts.items()])
    return u.groupBy("part").agg(F.count("*").alias("n"), F.count("t").alias("n_texts"), F.countDistinct("t").alias("n_distinct"))
