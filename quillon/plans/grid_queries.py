"""Grids, arms, knowledge builds and event windows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import grid as J
from quillon.operators import sets as U
from quillon.plans.measure_queries import rows
from quillon.plans.registry import query
from quillon.plans.retrieval_queries import WS
from quillon.plans.runtime import table
from quillon.streaming import replay as R


def _dim(spark, d, c):
    return rows(spark, d).select(c).distinct()


@query("SELECT * FROM (SELECT DISTINCT dataset FROM result_items), (SELECT DISTINCT backbone FROM result_items), (SELECT DISTINCT split FROM result_items)")
def grid_cells(spark, d):
    return J.cells(_dim(spark, d, "dataset"), _dim(spark, d, "backbone"), _dim(spark, d, "split"))


@query("""
WITH g AS (SELECT * FROM (SELECT DISTINCT dataset FROM result_items), (SELECT DISTINCT backbone FROM result_items), (SELECT DISTINCT split FROM result_items))
SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM result_cells c WHERE c.dataset = g.dataset AND c.backbone = g.backbone AND c.split = g.split AND c.aggregate.mean IS NOT NULL)""")
def pending_cells(spark, d):
    return J.pending(grid_cells(spark, d), table(spark, d, "result_cells").where("aggregate.mean is not null"), ["dataset", "backbone", "split"])


@query()
def ablation_arms(spark, d):
    """One-factor arms of a retrieval configuration, over every data set."""
    base = {"kind": "dense-topk", "k": "5", "delivery": "flat", "query": "transcript"}
    axes = {"kind": ["dense-topk", "fixed-threshold", "hybrid-bm25-dense-rrf", "two-stage"], "k": ["1", "5", "20"], "delivery": ["flat", "structured-ref", "relevance-edge-reorder"], "query": ["transcript", "audio"]}
    arms = spark.createDataFrame([(n, *c.values()) for n, c in J.one_factor(base, axes)], "arm string, kind string, k string, delivery string, query string")
    return J.cells(_dim(spark, d, "dataset"), arms)


@query("""
WITH f AS (SELECT dataset, item_id, backbone, min(row_id) AS row_id FROM result_items WHERE score IS NOT NULL GROUP BY ALL), r AS (SELECT f.dataset, f.item_id, f.backbone, i.score, i.group_id FROM f JOIN result_items i USING (row_id))
SELECT a.dataset, a.item_id, a.score AS a, b.score AS b, coalesce(a.group_id, b.group_id) AS grp FROM r a JOIN r b USING (dataset, item_id) WHERE a.backbone = 'meralion-2-gguf' AND b.backbone = 'tiny-audio-1b-gguf'""")
def arm_pairs(spark, d):
    first = U.first_of(rows(spark, d).where("score is not null"), ["dataset", "item_id", "backbone"], ["row_id"])
    arm = lambda m: first.where(F.col("backbone") == m)
    return J.paired(arm("meralion-2-gguf"), arm("tiny-audio-1b-gguf"), ["dataset", "item_id"], "score", "group_id")


@query("""
SELECT r.row_id, c.cell_id IS NOT NULL AS resolved, CASE WHEN c.cell_id IS NOT NULL THEN coalesce((r.reply = r.detail.gold)::INT, 0) END AS new_score
FROM result_items r LEFT JOIN (SELECT cell_id FROM result_cells WHERE aggregate.mean IS NOT NULL) c USING (cell_id)""")
def rescored_replies(spark, d):
    c = table(spark, d, "result_cells").where("aggregate.mean is not null").select("cell_id")
    r = rows(spark, d).select("row_id", "cell_id", "reply", "detail")
    return J.rescored(r, c, ["cell_id"], F.coalesce((F.col("reply") == F.col("detail.gold")).cast("int"), F.lit(0))).select("row_id", "resolved", "new_score")


@query("SELECT o_custkey AS q, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_partkey, l_linenumber) AS docs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def judged_documents(spark, d):
    """Judgements gathered per query, with the order tables as queries and judged parts."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return J.relevant(j.select(F.col("o_custkey").alias("q"), "l_partkey", "l_linenumber"), "q", "l_partkey", "l_linenumber").select(
        "q", F.array_join(F.transform("docs", lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["score"].cast("string"))), ",").alias("docs")
    )


@query("SELECT count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS judged, count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS distractors FROM part")
def judged_and_distractors(spark, d):
    p, l_ = table(spark, d, "part"), table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("j", F.lit(1))
    return p.join(l_, "p_partkey", "left").agg(F.count("j").alias("judged"), F.count_if(F.col("j").isNull()).alias("distractors"))


@query("SELECT row_id FROM result_items r WHERE NOT EXISTS (SELECT 1 FROM result_cells c WHERE c.cell_id = r.cell_id AND c.stage = 'wave1')")
def resume_rows(spark, d):
    return rows(spark, d).select("row_id", "cell_id").join(table(spark, d, "result_cells").where("stage = 'wave1'"), "cell_id", "left_anti").select("row_id")


@query("""
WITH m AS (SELECT dataset, backbone, avg(score) AS m FROM result_items GROUP BY ALL)
SELECT dataset, round(a.m, 6) AS meralion, round(b.m, 6) AS qwen, round(c.m, 6) AS tiny FROM (SELECT dataset, m FROM m WHERE backbone = 'meralion-2-gguf') a
FULL JOIN (SELECT dataset, m FROM m WHERE backbone = 'qwen3-omni-30b-gguf') b USING (dataset) FULL JOIN (SELECT dataset, m FROM m WHERE backbone = 'tiny-audio-1b-gguf') c USING (dataset)""")
def surfaces(spark, d):
    m = rows(spark, d).groupBy("dataset", "backbone").agg(F.round(F.avg("score"), 6).alias("m"))
    part = lambda b: m.where(F.col("backbone") == b).select("dataset", "m")
    return J.full_outer({"meralion": part("meralion-2-gguf"), "qwen": part("qwen3-omni-30b-gguf"), "tiny": part("tiny-audio-1b-gguf")}, "dataset").select("dataset", F.col("meralion_m").alias("meralion"), F.col("qwen_m").alias("qwen"), F.col("tiny_m").alias("tiny"))


@query("SELECT dataset, split, meralion, qwen FROM (PIVOT (SELECT dataset, split, backbone, score FROM result_items WHERE backbone IN ('meralion-2-gguf', 'qwen3-omni-30b-gguf')) ON backbone IN ('meralion-2-gguf' AS meralion, 'qwen3-omni-30b-gguf' AS qwen) USING count(score) GROUP BY dataset, split)".replace(" AS meralion, ", ", ").replace(" AS qwen)", ")").replace("SELECT dataset, split, meralion, qwen", "SELECT dataset, split, \"meralion-2-gguf\" AS meralion, \"qwen3-omni-30b-gguf\" AS qwen"))
def arm_pivot(spark, d):
    p = rows(spark, d).where("backbone in ('meralion-2-gguf', 'qwen3-omni-30b-gguf')").groupBy("dataset", "split").pivot("backbone", ["meralion-2-gguf", "qwen3-omni-30b-gguf"]).agg(F.count("score"))
    return p.select("dataset", "split", F.coalesce("`meralion-2-gguf`", F.lit(0)).alias("meralion"), F.coalesce("`qwen3-omni-30b-gguf`", F.lit(0)).alias("qwen"))


@query("""
WITH c AS (SELECT dataset, cell_id, aggregate.mean AS m, started_at FROM result_cells WHERE aggregate.mean IS NOT NULL), w AS (SELECT *, max(m) OVER (PARTITION BY dataset ORDER BY cell_id) AS b,
 max(m) OVER (PARTITION BY dataset ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c) SELECT cell_id, round(b, 6) AS best_so_far, p IS NULL OR m > p AS improved FROM w""")
def running_best(spark, d):
    c = table(spark, d, "result_cells").select("dataset", "cell_id", F.col("aggregate.mean").alias("m")).where("m is not null")
    return J.running_best(c, ["dataset"], "cell_id", "m").select("cell_id", F.round("best_so_far", 6).alias("best_so_far"), "improved")


@query("""
WITH r AS (SELECT source, kid, content, row_number() OVER (PARTITION BY kid, content ORDER BY card_id) AS n FROM knowledge_cards WHERE kid IS NOT NULL AND trim(content) <> '')
SELECT source || ':' || left(sha1(kid || '|' || content), 12) AS kid, source, 'passage' AS value_type, content AS value, kid AS key_ref, 'utterance' AS key_granularity FROM r WHERE n = 1""")
def knowledge_values(spark, d):
    return J.knowledge_values(table(spark, d, "knowledge_cards"), "source", "kid", "content", "passage", "card_id")


@query()
def knowledge_children(spark, d):
    return J.child_rows(knowledge_values(spark, d))


@query("""
WITH r AS (SELECT source, content, card_id, row_number() OVER (PARTITION BY source ORDER BY card_id) AS i FROM knowledge_cards WHERE content IS NOT NULL)
SELECT source, count(*) AS n, left(string_agg(left(content, 80), ' | ' ORDER BY i) FILTER (WHERE i <= 5), 300) AS summary FROM r GROUP BY 1""")
def cluster_summaries(spark, d):
    return J.cluster_summaries(table(spark, d, "knowledge_cards").where("content is not null"), "source", "content", "card_id")


@query("SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS INT)) AS n_k, sum(try_cast(json_extract_string(props, '$.k') AS INT))::BIGINT AS total FROM events GROUP BY 1")
def event_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.windowed_counts(e, "ts", "event_type", "value", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def user_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = R.sessions(e, "ts", "user_id", "6 hours")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


RARE = f"""
t AS (SELECT row_id, dataset, item_id, group_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(reply, '')), '{WS}'), lambda x: length(x) >= 4))) AS w FROM result_items WHERE group_id IS NOT NULL),
r AS (SELECT w FROM t GROUP BY w HAVING count(*) <= 20), o AS (SELECT DISTINCT dataset, item_id, group_id, w FROM t WHERE w IN (SELECT w FROM r))"""


@query(f"WITH {RARE}, g AS (SELECT group_id, w, count(*) AS n FROM o GROUP BY ALL) SELECT o.dataset, o.item_id, o.group_id, count(*) AS n_rare, count(*) FILTER (WHERE n > 1) AS n_elsewhere FROM o JOIN g USING (group_id, w) GROUP BY ALL")
def shared_rare_tokens(spark, d):
    """Rare words of an item that other items of its group hold too, by counts per group and word instead of pairs."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("reply", F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda x: F.length(x) >= 4))
    t = rows(spark, d).where("group_id is not null").select("row_id", "dataset", "item_id", "group_id", F.explode(words).alias("w"))
    rare = t.groupBy("w").agg(F.count("*").alias("f")).where("f <= 20").select("w")
    o = t.join(rare, "w").select("dataset", "item_id", "group_id", "w").distinct()
    g = o.groupBy("group_id", "w").agg(F.count("*").alias("n"))
    return o.join(g, ["group_id", "w"]).groupBy("dataset", "item_id", "group_id").agg(F.count("*").alias("n_rare"), F.count_if(F.col("n") > 1).alias("n_elsewhere"))


@query("""
WITH q AS (SELECT eval_id, row_number() OVER (ORDER BY eval_id) - 1 AS i FROM eval_items), p AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS i, count(*) OVER () AS k FROM result_cells), s AS (SELECT unnest(range(3)) AS j)
SELECT eval_id, j::INT AS shot, cell_id FROM q, s JOIN p ON true WHERE p.i = (q.i + s.j) % p.k""")
def rotating_exemplars(spark, d):
    """Three exemplars for every question, taken in turn from a numbered pool by an equi-join on the remainder."""
    q = table(spark, d, "eval_items").select("eval_id", (F.row_number().over(Window.orderBy("eval_id")) - 1).alias("qi"))  # 240 rows at every scale
    c = table(spark, d, "result_cells").select("cell_id")
    p = c.withColumn("i", F.row_number().over(Window.orderBy("cell_id")) - 1)  # a row per run of a backbone, not per item
    n = c.agg(F.count("*").alias("k"))
    want = q.crossJoin(F.broadcast(n)).select("eval_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shot"), "qi", "k").withColumn("i", ((F.col("qi") + F.col("shot")) % F.col("k")).cast("int"))
    return want.join(p, "i").select("eval_id", "shot", "cell_id")


@query("""
WITH s AS (SELECT group_id, avg(score) AS m, count(*) AS n, n_regionkey FROM result_items r JOIN nation ON n_nationkey = r.row_id % 25 WHERE score IS NOT NULL AND group_id IS NOT NULL GROUP BY ALL)
SELECT r_name, CASE WHEN GROUPING(group_id) = 1 THEN 'all' ELSE group_id END AS grp, sum(n)::BIGINT AS n, round(sum(m * n) / sum(n), 6) AS mean FROM s JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, group_id), (r_name))""")
def support_by_grain(spark, d):
    """Mean scores at two grains at once, with blocks taken from the small tables."""
    s = rows(spark, d).where("score is not null and group_id is not null").withColumn("n_nationkey", (F.col("row_id") % 25).cast("int"))
    s = s.join(F.broadcast(table(spark, d, "nation")), "n_nationkey").groupBy("group_id", "n_regionkey").agg(F.avg("score").alias("m"), F.count("*").alias("n"))  # 25 rows
    j = s.join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # 5 rows
    g = j.groupingSets([["r_name", "group_id"], ["r_name"]], "r_name", "group_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.grouping("group_id").alias("g"))
    return g.select("r_name", F.when(F.col("g") == 1, "all").otherwise(F.col("group_id")).alias("grp"), "n", "mean")
