"""Scorers by kind of task, selectors and censuses, and the fixed points of the intervals, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import scoring
from quillon.functions.text import options, speech_tokens
from quillon.operators import selectors as L
from quillon.operators import stats as T
from quillon.plans.measure_queries import BY, POOL, arms, pool, rows
from quillon.plans.registry import ORACLES, query
from quillon.plans.retrieval_queries import norm_sql
from quillon.plans.runtime import broadcast_if_small, cut, table

OPTIONS_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(instr, ''), '^[^\0]*?(\([A-H]\)|$)', '\1'), '\([A-H]\)[ \t\n\r\f\v]*'), lambda x: trim(regexp_extract(x, '^[^\n\r\x{85}\x{2028}\x{2029}]*'))), lambda x: x <> '')"


def choice_sql(reply: str, labels: str) -> str:
    """The option of a reply, as scoring.parse_choice gives it, for up to eight options."""
    held = f"list_sort(list_filter(list_transform({labels}, lambda o, i: {{'n': -length({norm_sql('o')}), 'i': i - 1, 'o': {norm_sql('o')}}}), lambda s: s.o <> '' AND contains({norm_sql(reply)}, s.o)))[1].i"
    start = rf"lower(left(regexp_replace({reply}, '^[ \t\n\r\f\v]+', ''), 2))"
    letter = f"strpos('abcdefgh', left({start}, 1)) - 1"
    alone = f"(lower(trim({reply})) = left({start}, 1) OR substr({start}, 2, 1) IN ('.', ')', ':', ' '))"
    few = f"CASE WHEN {start} <> '' AND {letter} >= 0 AND {letter} < len({labels}) AND {alone} THEN {letter} ELSE coalesce({held}, -1) END"
    return f"(CASE WHEN len({labels}) = 0 THEN -1 ELSE {few} END)::INT"


CHOICES = f"c AS (SELECT row_id, coalesce(reply, '') AS reply, detail.gold AS gold, {OPTIONS_SQL} AS opts FROM result_items WHERE contains(instr, '(A)'))"
ORACLES["choice_parse"] = f"WITH {CHOICES} SELECT row_id, {choice_sql('reply', 'opts')} AS choice, lower(gold) AS gold FROM c"


def position_sql(labels: str, name: str) -> str:
    return f"nullif(list_position(list_transform({labels}, lambda x: {norm_sql('x')}), {norm_sql(name)}), 0) - 1"


def match_sql(gold: str, reply: str, labels: str) -> str:
    letter = f"strpos('ABCDEFGH', upper(left(trim({gold}), 1))) - 1"
    named = f"CASE WHEN (length(trim({gold})) <= 2 OR regexp_matches(trim({gold}), '^[A-H][.，、:]')) AND {letter} >= 0 AND {letter} < len({labels}) THEN {letter} END"
    return f"coalesce(({choice_sql(reply, labels)} = coalesce({position_sql(labels, gold)}, {named}))::INT, 0)"


@query(f"WITH {CHOICES} SELECT row_id, {match_sql('gold', 'reply', 'opts')} AS em FROM c")
def choice_match(spark, d):
    r = rows(spark, d).where(F.contains("instr", F.lit("(A)")))
    return r.select("row_id", scoring.choice_match(F.col("detail.gold"), F.col("reply"), options(F.col("instr"))).alias("em"))


LABELS = "(SELECT list_sort(list(DISTINCT lower(detail.gold))) FROM result_items WHERE dataset = 'voicebench-bbh' AND detail.gold IS NOT NULL)"
BBH = f"c AS (SELECT row_id, coalesce(reply, '') AS reply, detail.gold AS gold, {LABELS}[1:8] AS labels FROM result_items WHERE dataset = 'voicebench-bbh')"
CHOSEN = f"WITH {BBH}, p AS (SELECT row_id, {choice_sql('reply', 'labels')} AS c, {position_sql('labels', 'gold')} AS g, labels FROM c)"


def _label_set(spark, d):
    """The closed set of the data set, of which the first eight labels are shown."""
    names = rows(spark, d).where("dataset = 'voicebench-bbh' and detail.gold is not null").select(F.lower("detail.gold").alias("g")).distinct()
    return names.agg(F.slice(F.sort_array(F.collect_list("g")), 1, 8).alias("labels"))  # distinct labels of a closed set


@query(f"{CHOSEN} SELECT row_id, coalesce(c >= 0 AND c = g, false)::INT AS em, CASE WHEN c >= 0 THEN labels[c + 1] END AS label FROM p")
def closed_choice(spark, d):
    r = rows(spark, d).where("dataset = 'voicebench-bbh'").select("row_id", "reply", F.col("detail.gold").alias("gold")).crossJoin(F.broadcast(_label_set(spark, d)))  # one row
    return r.select("row_id", scoring.closed_choice(F.col("gold"), F.col("reply"), F.col("labels")).alias("s")).select("row_id", "s.em", "s.label")


INTENTS = f"""i AS (SELECT dataset, list_sort(list(DISTINCT detail.gold)) AS names FROM result_items WHERE starts_with(dataset, 'speech-massive') AND detail.gold IS NOT NULL GROUP BY 1),
c AS (SELECT row_id, reply, detail.gold AS gold, names FROM result_items JOIN i USING (dataset)),
p AS (SELECT row_id, try_cast(regexp_extract(reply, '^[ \\t\\n\\r\\f\\v]*([0-9]+)', 1) AS INT) AS n, {position_sql('names', 'gold')} AS g, gold <> '' AND contains({norm_sql('reply')}, {norm_sql('gold')}) AS held FROM c)"""


@query(f"WITH {INTENTS} SELECT row_id, coalesce((n = g) OR held, held, false)::INT AS em FROM p")
def intent_match(spark, d):
    r = rows(spark, d).where("dataset like 'speech-massive%'")
    names = r.where("detail.gold is not null").select("dataset", F.col("detail.gold").alias("g")).distinct().groupBy("dataset").agg(F.sort_array(F.collect_list("g")).alias("names"))  # the names of an intent list
    return r.join(broadcast_if_small(cut(names)), "dataset").select("row_id", scoring.intent_match(F.col("detail.gold"), F.col("reply"), F.col("names")).alias("em"))


YES = f"CASE WHEN {norm_sql('reply')} LIKE 'yes%' THEN ({norm_sql('gold')} = 'yes')::INT WHEN {norm_sql('reply')} LIKE 'no%' THEN ({norm_sql('gold')} = 'no')::INT ELSE 0 END"


@query(f"""
WITH c AS (SELECT row_id, k_type, reply, detail.gold AS gold, {OPTIONS_SQL} AS opts FROM result_items JOIN result_cells USING (cell_id))
SELECT row_id, k_type, CASE WHEN reply IS NULL THEN NULL
 WHEN k_type = 'K6' THEN coalesce(gold <> '' AND contains({norm_sql('reply')}, {norm_sql('gold')}), false)::INT::DOUBLE
 WHEN k_type = 'K8' THEN coalesce(CASE WHEN {norm_sql('gold')} IN ('yes', 'no') THEN {YES} WHEN len(opts) > 0 THEN {match_sql('gold', 'reply', 'opts')} ELSE ({norm_sql('gold')} <> '' AND contains({norm_sql('reply')}, {norm_sql('gold')}))::INT END, 0)::DOUBLE END AS score FROM c""")
def k_scores(spark, d):
    """Every reply scored by the kind of task of its cell; intents by name."""
    kinds = table(spark, d, "result_cells").select("cell_id", "k_type")
    r = rows(spark, d).join(broadcast_if_small(kinds), "cell_id")
    none = F.array().cast("array<string>")
    return r.select("row_id", "k_type", scoring.by_k_type(F.col("k_type"), F.col("detail.gold"), F.col("reply"), none, options(F.coalesce("instr", F.lit("")))).alias("score"))


ORACLES["reply_scores"] = f"""
WITH c AS (SELECT row_id, detail.task AS t, detail.gold AS gold, reply FROM result_items), k AS (SELECT *, CASE WHEN t = 'qa' THEN 'qa' WHEN lower(gold) IN ('yes', 'no') THEN 'yesno' ELSE 'choice' END AS task FROM c)
SELECT row_id, task, CASE WHEN gold IS NULL OR reply IS NULL THEN NULL WHEN task = 'yesno' THEN ({YES})::DOUBLE WHEN task = 'choice' THEN (left(lower(trim(reply)), 1) = left(lower(trim(gold)), 1))::INT::DOUBLE
 ELSE ({norm_sql('gold')} <> '' AND contains({norm_sql('reply')}, {norm_sql('gold')}))::INT::DOUBLE END AS score,
 ({' OR '.join(f"contains({norm_sql('reply')}, '{p}')" for p in sorted({''.join(c for c in p if c.isalnum() or c == ' ') for p in scoring.REFUSALS}))})::INT AS refused FROM k"""


# -- selectors -------------------------------------------------------------------------------------------------------

PICKS = f"""{POOL}, n AS (SELECT unnest([1, 2, 4, 8])::INT AS n_first), x AS (SELECT dataset, item_id, idx::INT AS idx, n_first, score::DOUBLE AS oracle, length(reply)::DOUBLE AS longest, -length(reply)::DOUBLE AS shortest FROM c JOIN n ON idx < n_first),
u AS (SELECT dataset, item_id, idx, n_first, s.selector, s.v FROM (SELECT *, unnest([{{'selector': 'oracle', 'v': oracle}}, {{'selector': 'longest', 'v': longest}}, {{'selector': 'shortest', 'v': shortest}}]) AS s FROM x) WHERE s.v IS NOT NULL)"""


@query(f"WITH {PICKS} SELECT dataset, item_id, n_first, selector, idx FROM (SELECT *, row_number() OVER (PARTITION BY dataset, item_id, n_first, selector ORDER BY v DESC, idx) AS r FROM u) WHERE r = 1")
def selector_battery(spark, d):
    p = pool(spark, d).withColumn("longest", F.length("reply")).withColumn("shortest", -F.length("reply"))
    return L.battery(p, ["dataset", "item_id"], {"oracle": "score", "longest": "longest", "shortest": "shortest"})


OVERLAP = f"""{POOL}, o AS (SELECT dataset, item_id, idx::INT AS idx, score::DOUBLE AS z, coalesce(length(detail.gold) % 3, 0)::INT + (idx % 2)::INT AS o, coalesce(length(reply), 0) AS n FROM c),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY z DESC, idx) AS r FROM o) WHERE r = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY o DESC, z DESC, idx) AS r FROM o) WHERE r = 1)"""


def _overlaps(spark, d):
    p = pool(spark, d)
    return p.select("dataset", "item_id", "idx", F.col("score").cast("double").alias("z"), (F.coalesce(F.length("detail.gold") % 3, F.lit(0)) + F.col("idx") % 2).alias("o"), F.coalesce(F.length("reply"), F.lit(0)).alias("n"))


@query(f"WITH {OVERLAP} SELECT dataset, item_id, a.idx AS first, CASE WHEN b.o > a.o THEN b.idx ELSE a.idx END AS idx, b.o > a.o AS flipped FROM a JOIN b USING (dataset, item_id)")
def overlap_flips(spark, d):
    return L.overlap_flip(_overlaps(spark, d), ["dataset", "item_id"], "o", "z")


@query(f"WITH {OVERLAP} SELECT dataset, item_id, (a.z - b.z) * b.n AS weight FROM a JOIN b USING (dataset, item_id) WHERE b.o > a.o")
def flip_weights(spark, d):
    return L.flip_weights(_overlaps(spark, d), ["dataset", "item_id"], "o", "z", "n")


@query("""
WITH t AS (SELECT dataset, backbone, lower(detail.pred) AS t, min(row_id) AS o, count(*) AS n FROM result_items WHERE detail.pred IS NOT NULL GROUP BY ALL),
g AS (SELECT dataset, backbone, 'yes' AS truth FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone ORDER BY n DESC, o) AS r FROM t)
SELECT dataset, backbone, r.r AS rank, coalesce(r.r = 1, false) AS top1, coalesce(r.r <= 3, false) AS top3 FROM g LEFT JOIN r USING (dataset, backbone) WHERE r.t = g.truth OR NOT EXISTS (SELECT 1 FROM t WHERE t.dataset = g.dataset AND t.backbone = g.backbone AND t.t = 'yes') GROUP BY ALL""".replace("SELECT dataset, backbone, r.r AS rank", "SELECT dataset, backbone, CASE WHEN r.t = 'yes' THEN r.r END AS rank").replace("coalesce(r.r = 1, false)", "coalesce(r.t = 'yes' AND r.r = 1, false)").replace("coalesce(r.r <= 3, false)", "coalesce(r.t = 'yes' AND r.r <= 3, false)"))
def truth_rank(spark, d):
    t = rows(spark, d).where("detail.pred is not null").select("dataset", "backbone", "row_id", F.lower("detail.pred").alias("t"), F.lit("yes").alias("truth"))
    return L.truth_rank(t, ["dataset", "backbone"], "t", "row_id", "truth")


@query("""
WITH k AS (SELECT dataset, item_id FROM result_items WHERE score IS NOT NULL GROUP BY ALL HAVING count(DISTINCT backbone) = 3)
SELECT dataset, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM result_items JOIN k USING (dataset, item_id) WHERE score IS NOT NULL GROUP BY 1""")
def complete_cases(spark, d):
    return L.complete_cases(rows(spark, d).where("score is not null"), ["dataset", "item_id"], "backbone", 3).groupBy("dataset").agg(F.count("*").alias("n_rows"), F.countDistinct("item_id").alias("n_items"))


@query()
def memory_by_replica(spark, d):
    """Memories apart for every backbone and speaker, with all candidates of an item and rows without a group left to themselves."""
    p = rows(spark, d).where("score is not null").withColumn("speaker", F.concat_ws("|", "backbone", F.coalesce("group_id", F.concat(F.lit("row:"), F.col("row_id").cast("string")))))
    p = p.withColumn("step", F.concat_ws("|", "dataset", "item_id")).select("speaker", "step", "row_id", "reply")
    p = p.withColumn("idx", (F.row_number().over(Window.partitionBy("speaker", "step").orderBy("row_id")) - 1).cast("int"))
    rare = L.rare_tokens(p, ["row_id"], "reply", most=50)
    z = L.z_scores(p.withColumn("n_tokens", F.size(speech_tokens(F.coalesce("reply", F.lit(""))))), ["speaker", "step"], "n_tokens")
    return L.memory_select(z.join(rare, "row_id").select("speaker", "step", "idx", "z", "n_tokens", "rare"), "speaker", "step", "set", 0.2, 1)


# -- what of the intervals doesn't depend on the draws -----------------------------------------------------------------

CLUSTERS = "c AS (SELECT dataset, backbone, split, coalesce(group_id, '__single__' || row_id) AS g, sum(score) AS s, count(*) AS n FROM result_items WHERE score IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {CLUSTERS} SELECT dataset, backbone, split, count(*) AS n_clusters, sum(n)::BIGINT AS n_items, CASE WHEN count(*) = sum(n) THEN 'item' ELSE 'cluster' END AS unit, true AS inside FROM c GROUP BY ALL""")
def interval_points(spark, d):
    c = T.cluster_bootstrap(rows(spark, d), BY, "score", "group_id", "row_id", nboot=10_000)
    exact = rows(spark, d).groupBy(*BY).agg(F.avg("score").alias("exact"))
    near = F.expr("abs(mean - exact) < 0.0001 and mean between lo - 0.0001 and hi + 0.0001")
    return c.join(exact, BY).select(*BY, "n_clusters", "n_items", "unit", near.alias("inside"))


ARMS_SQL = """a AS (SELECT dataset, item_id, avg(score) AS a, min(group_id) AS ga FROM result_items WHERE backbone = 'meralion-2-gguf' AND score IS NOT NULL GROUP BY ALL),
b AS (SELECT dataset, item_id, avg(score) AS b, min(group_id) AS gb FROM result_items WHERE backbone = 'qwen3-omni-30b-gguf' AND score IS NOT NULL GROUP BY ALL),
j AS (SELECT dataset, item_id, a - b AS delta, coalesce(ga, gb, '__single__' || item_id) AS g FROM a JOIN b USING (dataset, item_id))"""


@query(f"WITH {ARMS_SQL} SELECT dataset, count(DISTINCT g) AS n_clusters, count(*) AS n_items, true AS inside FROM j GROUP BY 1")
def paired_points(spark, d):
    p = T.paired_bootstrap(arms(spark, d), ["dataset"], "a", "b", "grp", "item_id", nboot=10_000)
    exact = arms(spark, d).groupBy("dataset").agg(F.avg(F.col("a") - F.col("b")).alias("exact"))
    near = F.expr("abs(delta - exact) < 0.0001 and delta between lo - 0.0001 and hi + 0.0001 and p between 0 and 1")
    return p.join(exact, "dataset").select("dataset", "n_clusters", "n_items", near.alias("inside"))


REPLICATES = """k AS (SELECT dataset, item_id FROM result_items WHERE score IS NOT NULL GROUP BY ALL HAVING count(DISTINCT backbone) = 3),
r AS (SELECT dataset, item_id, backbone, sum(1 - score)::DOUBLE AS e, count(*)::DOUBLE AS n FROM result_items JOIN k USING (dataset, item_id) WHERE score IS NOT NULL GROUP BY ALL),
f AS (SELECT dataset, item_id, backbone, e, n, first_value(e / n) OVER (PARTITION BY dataset, item_id ORDER BY backbone) * n AS g FROM r)"""


def _replicates(spark, d):
    full = L.complete_cases(rows(spark, d).where("score is not null"), ["dataset", "item_id"], "backbone", 3)
    r = full.groupBy("dataset", "item_id", "backbone").agg(F.sum(1 - F.col("score")).cast("double").alias("e"), F.count("*").cast("double").alias("n"))
    return r.withColumn("g", F.first(F.col("e") / F.col("n")).over(Window.partitionBy("dataset", "item_id").orderBy("backbone")) * F.col("n"))


@query(f"WITH {REPLICATES} SELECT dataset, count(DISTINCT item_id) AS n_items, true AS inside FROM f GROUP BY 1")
def hierarchical_intervals(spark, d):
    """Error rates of three backbones against the first of them, items and then backbones drawn; 10,000 draws."""
    r = _replicates(spark, d)
    h = T.hierarchical_bootstrap(r, ["dataset"], "item_id", "backbone", "e", "n", "g", nboot=10_000)
    exact = r.groupBy("dataset").agg(F.avg(F.expr("g / n - e / n")).alias("macro"), F.expr("(sum(g) - sum(e)) / sum(n)").alias("corpus"))
    near = F.expr("abs(macro_delta - macro) < 0.00001 and abs(corpus_delta - corpus) < 0.00001 and macro_lo <= macro_hi and corpus_lo <= corpus_hi and macro_sig = (macro_lo > 0)")
    return h.join(exact, "dataset").select("dataset", "n_items", near.alias("inside"))


@query("""
WITH f AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AND event_type IS NOT NULL)::INT AS f FROM events)
SELECT user_id, event_id, coalesce(sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_past FROM f""")
def past_memory_all(spark, d):
    """Distinct event types before each event, with a memory that forgets nothing."""
    return L.past_distinct(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", "n_past")
