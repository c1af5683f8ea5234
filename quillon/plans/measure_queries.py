"""Scores, grouped measures, statistics, selectors and rendering as queries over the result tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import render, scoring
from quillon.operators import aggregates as G
from quillon.operators import selectors as L
from quillon.operators import stats as T
from quillon.plans.registry import query
from quillon.plans.retrieval_queries import norm_sql, split_sql
from quillon.plans.runtime import table

BY = ["dataset", "backbone", "split"]


def rows(spark, d):
    return table(spark, d, "result_items")


# -- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT dataset, backbone, split, count(*) AS n, count(score) AS n_scored, sum(score)::BIGINT AS total, round(avg(score), 6) AS mean FROM result_items GROUP BY ALL")
def cell_means(spark, d):
    return rows(spark, d).groupBy(*BY).agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.sum("score").alias("total"), F.round(F.avg("score"), 6).alias("mean"))


@query("SELECT coalesce(dataset, 'all') AS dataset, coalesce(backbone, 'all') AS backbone, count(*) AS n, round(avg(score), 6) AS mean FROM result_items GROUP BY ROLLUP (dataset, backbone)")
def rollup_means(spark, d):
    r = rows(spark, d).rollup("dataset", "backbone").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return r.select(F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("backbone", F.lit("all")).alias("backbone"), "n", "mean")


LABELLED = "l AS (SELECT backbone, lower(detail.gold) AS g, lower(detail.pred) AS p FROM result_items WHERE dataset = 'voicebench-bbh' AND detail.gold IS NOT NULL)"
F1 = f"""{LABELLED}, g AS (SELECT backbone, g AS label, count(*) AS support, count(*) FILTER (WHERE g = p) AS tp FROM l GROUP BY ALL), s AS (SELECT backbone, p AS label, count(*) AS said FROM l WHERE p IS NOT NULL GROUP BY ALL),
x AS (SELECT backbone, label, support, CASE WHEN coalesce(said, 0) > 0 THEN tp / said ELSE 0 END AS p, tp / support AS r FROM g LEFT JOIN s USING (backbone, label)),
f AS (SELECT backbone, label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support FROM x)"""


def _labels(spark, d):
    return rows(spark, d).where("dataset = 'voicebench-bbh'").select("backbone", F.lower("detail.gold").alias("g"), F.lower("detail.pred").alias("p"))


@query(f"WITH {F1} SELECT * FROM f")
def label_f1(spark, d):
    return G.macro_f1(_labels(spark, d), ["backbone"], "g", "p")[0]


@query(f"WITH {F1} SELECT backbone, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1")
def macro_f1(spark, d):
    return G.macro_f1(_labels(spark, d), ["backbone"], "g", "p")[1].select("backbone", F.round("macro_f1", 6).alias("macro_f1"))


@query("""
WITH w AS (SELECT dataset, row_id, unnest(string_split(lower(detail.gold), ' ')) AS phrase FROM result_items WHERE detail.gold IS NOT NULL), g AS (SELECT *, count(*) AS g FROM w GROUP BY ALL),
v AS (SELECT dataset, row_id, unnest(string_split(lower(reply), ' ')) AS phrase FROM result_items WHERE reply IS NOT NULL), p AS (SELECT *, count(*) AS p FROM v GROUP BY ALL),
j AS (SELECT dataset, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (dataset, row_id, phrase))
SELECT dataset, sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn, round(2 * sum(least(g, p)) / (2 * sum(least(g, p)) + sum(greatest(p - g, 0)) + sum(greatest(g - p, 0))), 6) AS f1 FROM j GROUP BY 1""")
def slot_f1(spark, d):
    words = lambda c: F.explode(F.split(F.lower(c), " ")).alias("phrase")
    r = rows(spark, d)
    g, p = r.select("dataset", "row_id", F.lit("w").alias("label"), words("detail.gold")), r.select("dataset", "row_id", F.lit("w").alias("label"), words("reply"))
    return G.slot_f1(g, p, ["dataset"], "row_id", "label", "phrase").select("dataset", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("""WITH c AS (SELECT dataset, item_id, reply, count(*) AS n, min(row_id) AS f FROM result_items WHERE reply IS NOT NULL GROUP BY ALL)
SELECT dataset, item_id, reply, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def mode_first_seen(spark, d):
    return G.mode_first(rows(spark, d), ["dataset", "item_id"], "reply", "row_id")


@query("SELECT dataset, list_sort(list(DISTINCT detail.gold)) AS labels FROM result_items WHERE dataset = 'voicebench-bbh' AND detail.gold IS NOT NULL GROUP BY 1")
def label_inventory(spark, d):
    return rows(spark, d).where("dataset = 'voicebench-bbh' and detail.gold is not null").groupBy("dataset").agg(F.sort_array(F.collect_set("detail.gold")).alias("labels"))


@query("SELECT split_part(error, ':', 1) AS reason, backbone, count(*) AS n FROM result_items WHERE error IS NOT NULL GROUP BY ALL")
def error_histogram(spark, d):
    return rows(spark, d).where("error is not null").groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("reason"), "backbone").agg(F.count("*").alias("n"))


@query("SELECT source, round(quantile_cont(n_chars, 0.025), 4) AS q025, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.975), 4) AS q975, round(stddev_pop(n_chars), 4) AS sd_pop, round(stddev_samp(n_chars), 4) AS sd FROM documents GROUP BY 1")
def quantiles(spark, d):
    q = lambda p: F.round(F.percentile("n_chars", F.lit(p)), 4)
    return table(spark, d, "documents").groupBy("source").agg(q(0.025).alias("q025"), q(0.5).alias("median"), q(0.975).alias("q975"), F.round(F.stddev_pop("n_chars"), 4).alias("sd_pop"), F.round(F.stddev_samp("n_chars"), 4).alias("sd"))


@query("SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def upper_medians(spark, d):
    return G.upper_median(table(spark, d, "documents"), ["source"], "n_chars")


POOL = "c AS (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY row_id) - 1 AS idx FROM result_items WHERE score IS NOT NULL)"


def pool(spark, d):
    return L.number_candidates(rows(spark, d).where("score is not null"), ["dataset", "item_id"], ["row_id"])


@query(f"""WITH {POOL}, i AS (SELECT dataset, item_id, avg(score) AS rate, count(*) AS m FROM c GROUP BY ALL), n AS (SELECT unnest([1, 2, 4, 8])::INT AS n_first),
h AS (SELECT dataset, item_id, n_first, max(score) AS hit FROM c, n WHERE idx < n_first GROUP BY ALL)
SELECT dataset, n_first, count(*) AS n_items, round(avg(1 - power(1 - rate, n_first)), 6) AS predicted, round(avg(hit), 6) AS observed FROM i, n JOIN h USING (dataset, item_id, n_first) WHERE m >= n_first GROUP BY ALL""".replace("FROM i, n JOIN h USING (dataset, item_id, n_first)", "FROM i JOIN h USING (dataset, item_id)"))
def coverage_by_n(spark, d):
    return G.coverage(pool(spark, d), ["dataset"], "item_id", "idx", "score").select("dataset", "n_first", "n_items", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


GAIN = f"{POOL}, i AS (SELECT dataset, item_id, arg_min(score, idx) AS g, max(score) AS o FROM c GROUP BY ALL), s AS (SELECT dataset, count(*) AS n_items, avg(g) AS greedy, avg(o) AS oracle FROM i GROUP BY 1)"


@query(f"WITH {GAIN} SELECT dataset, n_items, round(greedy, 6) AS greedy, round(oracle, 6) AS oracle, round(oracle - greedy, 6) AS delta, greedy >= 0.9 AS saturated FROM s")
def oracle_gain(spark, d):
    g = G.oracle_gain(pool(spark, d), ["dataset"], "item_id", "idx", "score")
    return g.select("dataset", "n_items", *[F.round(c, 6).alias(c) for c in ("greedy", "oracle", "delta")], "saturated")


@query(f"""WITH {GAIN}, e AS (SELECT dataset, item_id, coalesce(min(idx) FILTER (WHERE reply = detail.gold), 0) AS idx FROM c GROUP BY ALL), v AS (SELECT dataset, avg(score) AS sel FROM c JOIN e USING (dataset, item_id, idx) GROUP BY 1)
SELECT dataset, round(sel, 6) AS selected, CASE WHEN oracle - greedy > 1e-9 THEN round((sel - greedy) / (oracle - greedy), 6) END AS rho FROM s JOIN v USING (dataset)""")
def verifier_realization(spark, d):
    """The first candidate that equals its gold is endorsed; how much of the headroom that realizes."""
    p = pool(spark, d).withColumn("vote", (F.col("reply") == F.col("detail.gold")).cast("int"))
    e = L.first_endorsed(p, ["dataset", "item_id"], "vote")
    sel = p.join(e, ["dataset", "item_id", "idx"]).groupBy("dataset").agg(F.avg("score").alias("sel"))
    g = G.oracle_gain(p, ["dataset"], "item_id", "idx", "score")
    return g.join(sel, "dataset").select("dataset", F.round("sel", 6).alias("selected"), F.round(G.realization(F.col("greedy"), F.col("sel"), F.col("oracle")), 6).alias("rho"))


@query(f"WITH {POOL} SELECT CASE WHEN idx < 4 THEN '1-4' WHEN idx < 8 THEN '5-8' WHEN idx < 12 THEN '9-12' ELSE 'later' END AS bin, count(*) AS n, round(avg(score), 6) AS mean FROM c GROUP BY 1")
def position_bins(spark, d):
    b = F.when(F.col("idx") < 4, "1-4").when(F.col("idx") < 8, "5-8").when(F.col("idx") < 12, "9-12").otherwise("later")
    return pool(spark, d).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("WITH m AS (SELECT backbone, avg(score) AS mean FROM result_items GROUP BY 1) SELECT backbone, round(mean, 6) AS mean FROM m WHERE mean >= (SELECT max(mean) FROM m) - 0.05 ORDER BY backbone LIMIT 1")
def winner_rule(spark, d):
    m = rows(spark, d).groupBy("backbone").agg(F.avg("score").alias("mean"))
    return G.winner(m, "mean", ["backbone"], 0.05).select("backbone", F.round("mean", 6).alias("mean"))


@query("SELECT dataset, split, count(*) AS n, sha256(string_agg(coalesce(cell_id::VARCHAR, '') || chr(31) || coalesce(backbone, ''), chr(30) ORDER BY cell_id)) AS stream_sha256 FROM result_cells GROUP BY ALL")
def stream_hash(spark, d):
    return G.ordered_stream_hash(table(spark, d, "result_cells"), ["dataset", "split"], "cell_id", ["cell_id", "backbone"])


@query("""SELECT cell_id, sha256('{"model": ' || coalesce('"' || model || '"', 'null') || ', "seed": "' || seed::VARCHAR || '", "split": "' || split || '"}') AS config_hash FROM result_cells""")
def config_hash(spark, d):
    c = table(spark, d, "result_cells")
    return c.select("cell_id", G.map_hash(F.create_map(F.lit("seed"), F.col("seed").cast("string"), F.lit("model"), F.col("model"), F.lit("split"), F.col("split"))).alias("config_hash"))


@query("""
WITH s AS (SELECT dataset, avg(score) FILTER (WHERE split = 'dev') AS dev, avg(score) FILTER (WHERE split = 'test') AS test, avg(score) AS base FROM result_items GROUP BY 1), v AS (SELECT dataset, (test - dev) / nullif(dev, 0) AS gain FROM s)
SELECT dataset, round(gain, 6) AS gain, gain > 0 AS up, count(*) FILTER (WHERE gain > 0) OVER () >= (count(*) OVER () + 1) // 2 AS majority FROM v""")
def relative_gain(spark, d):
    s = rows(spark, d).groupBy("dataset").agg(F.avg(F.when(F.col("split") == "dev", F.col("score"))).alias("dev"), F.avg(F.when(F.col("split") == "test", F.col("score"))).alias("test"))
    v = s.select("dataset", ((F.col("test") - F.col("dev")) / F.nullif(F.col("dev"), F.lit(0))).alias("gain"))
    every = v.agg(F.count_if(F.col("gain") > 0).alias("ups"), F.count("*").alias("all"))
    return v.crossJoin(F.broadcast(every)).select("dataset", F.round("gain", 6).alias("gain"), (F.col("gain") > 0).alias("up"), (F.col("ups") >= F.floor((F.col("all") + 1) / 2)).alias("majority"))  # one row


# -- scores ----------------------------------------------------------------------------------------------------------


@query()
def char_error(spark, d):
    """Character error rate of every reply; the SQL engine's edit distance counts bytes, so this has no SQL."""
    return rows(spark, d).select("row_id", F.round(scoring.char_error_rate(F.col("detail.gold"), F.col("reply")), 6).alias("cer"))


@query()
def reply_scores(spark, d):
    """Every reply scored by its kind of task."""
    task = F.when(F.col("detail.task") == "qa", "qa").when(F.lower("detail.gold").isin("yes", "no"), "yesno").otherwise("choice")
    return rows(spark, d).select("row_id", task.alias("task"), scoring.by_task(task, F.col("detail.gold"), F.col("reply")).alias("score"), scoring.refused(F.col("reply")).alias("refused"))


@query()
def word_error(spark, d):
    """Corpus and mean word error rate of replies against golds."""
    a = rows(spark, d).select("dataset", scoring.word_alignment(F.col("detail.gold"), F.col("reply")).alias("a")).where("a.n > 0")
    return a.groupBy("dataset").agg((F.sum(F.expr("a.s + a.d + a.i")) / F.sum("a.n")).alias("corpus_wer"), F.avg("a.wer").alias("mean_wer"), F.sum("a.h").alias("hits"))


@query(f"""
WITH r AS (SELECT row_id, {norm_sql('reply')} AS t, {norm_sql('detail.gold')} AS g FROM result_items)
SELECT row_id, coalesce(CASE WHEN t LIKE 'yes%' THEN (g = 'yes')::INT WHEN t LIKE 'no%' THEN (g = 'no')::INT END, 0) AS em FROM r""")
def yes_no_match(spark, d):
    return rows(spark, d).select("row_id", scoring.yes_no(F.col("detail.gold"), F.col("reply")).alias("em"))


@query()
def choice_parse(spark, d):
    from quillon.functions.text import options

    r = rows(spark, d).where(F.contains("instr", F.lit("(A)")))
    return r.select("row_id", scoring.parse_choice(F.coalesce("reply", F.lit("")), options(F.col("instr"))).alias("choice"), F.lower("detail.gold").alias("gold"))


@query(f"""
WITH t AS (SELECT row_id, {split_sql(norm_sql('detail.gold'))} AS x, {split_sql(norm_sql('reply'))} AS y, detail.gold IS NULL OR reply IS NULL AS none FROM result_items),
c AS (SELECT row_id, x, y, none, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS n FROM t)
SELECT row_id, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * coalesce(n, 0) / (len(x) + len(y)), 6) END::DOUBLE AS f1 FROM c""")
def token_f1(spark, d):
    return rows(spark, d).select("row_id", F.round(scoring.token_f1(F.col("detail.gold"), F.col("reply")), 6).alias("f1"))


@query(f"SELECT row_id, ({norm_sql('detail.gold')} <> '' AND contains({norm_sql('reply')}, {norm_sql('detail.gold')}))::INT AS em FROM result_items")
def gold_containment(spark, d):
    return rows(spark, d).select("row_id", scoring.contains_gold(F.col("detail.gold"), F.col("reply")).alias("em"))


@query(f"SELECT row_id, ({' OR '.join(f'contains(t, {chr(39)}{p}{chr(39)})' for p in sorted({''.join(c for c in p if c.isalnum() or c == ' ') for p in scoring.REFUSALS}))})::INT AS refused FROM (SELECT row_id, {norm_sql('reply')} AS t FROM result_items)")
def refusal_phrases(spark, d):
    return rows(spark, d).select("row_id", scoring.refused(F.col("reply")).alias("refused"))


# -- statistics ------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT dataset, backbone, split, 1 - abs(2 * avg(score) - 1) AS p FROM result_items WHERE score IS NOT NULL GROUP BY ALL),
s AS (SELECT *, least(1.0, (count(*) OVER f + 1 - row_number() OVER (f ORDER BY p, backbone, split)) * p) AS s FROM p WINDOW f AS (PARTITION BY dataset))
SELECT dataset, backbone, split, round(max(s) OVER (PARTITION BY dataset ORDER BY p, backbone, split), 6) AS p_holm, max(s) OVER (PARTITION BY dataset ORDER BY p, backbone, split) <= 0.05 AS reject FROM s""")
def holm_by_family(spark, d):
    p = rows(spark, d).where("score is not null").groupBy(*BY).agg((1 - F.abs(2 * F.avg("score") - 1)).alias("p"))
    return T.holm(p, "p", ["dataset"], ["backbone", "split"]).select(*BY, "p_holm", "reject")


@query("""
WITH c AS (SELECT dataset, cell_id, avg(score) AS y, var_samp(score) / count(score) AS v FROM result_items WHERE score IS NOT NULL GROUP BY ALL HAVING count(score) > 1),
w AS (SELECT *, 1 / CASE WHEN v > 0 THEN v ELSE 1e-12 END AS w FROM c), s AS (SELECT dataset, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * y) / sum(w) AS m FROM w GROUP BY 1),
q AS (SELECT dataset, any_value(k) AS k, any_value(sw) - any_value(sw2) / any_value(sw) AS c, sum(w * power(y - m, 2)) AS q FROM w JOIN s USING (dataset) GROUP BY 1),
t AS (SELECT dataset, k, CASE WHEN k > 1 THEN q ELSE 0 END AS q, CASE WHEN k > 1 AND c > 0 THEN greatest(0, (q - (k - 1)) / c) ELSE 0 END AS tau2, CASE WHEN k > 1 AND q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2 FROM q),
p AS (SELECT dataset, sum(y / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS pooled, sqrt(1 / sum(1 / (1 / w + tau2))) AS se FROM w JOIN t USING (dataset) GROUP BY 1)
SELECT dataset, k, round(tau2, 5) AS tau2, round(i2, 5) AS i2, round(pooled, 5) AS pooled, round(se, 5) AS se, round(pooled - 1.959963984540054 * se, 5) AS lo, round(pooled + 1.959963984540054 * se, 5) AS hi FROM t JOIN p USING (dataset)""")
def random_effects(spark, d):
    c = rows(spark, d).where("score is not null").groupBy("dataset", "cell_id").agg(F.avg("score").alias("y"), (F.var_samp("score") / F.count("score")).alias("v"), F.count("score").alias("n")).where("n > 1")
    return T.random_effects(c, ["dataset"], "y", "v").select("dataset", "k", *[F.round(x, 5).alias(x) for x in ("tau2", "i2", "pooled", "se", "lo", "hi")])


@query("""
WITH g AS (SELECT dataset, group_id, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM result_items WHERE score IS NOT NULL AND group_id IS NOT NULL GROUP BY ALL),
s AS (SELECT dataset, count(*) AS k, sum(n) AS t, sum(n * n) AS n2, sum(n * m) AS sm, sum(n * m * m) AS smm, sum(n * v) AS w FROM g GROUP BY 1),
b AS (SELECT dataset, k, t, (smm - sm * sm / t) / (k - 1) AS msb, w / (t - k) AS msw, (t - n2 / t) / (k - 1) AS n0 FROM s)
SELECT dataset, k AS n_groups, t::BIGINT AS n_items, round(msb / msw, 5) AS f, round((msb - msw) / (msb + (n0 - 1) * msw), 5) AS icc FROM b""")
def icc1(spark, d):
    return T.intraclass(rows(spark, d), ["dataset"], "score", "group_id").select("dataset", "n_groups", "n_items", F.round("f", 5).alias("f"), F.round("icc", 5).alias("icc"))


@query()
def cluster_intervals(spark, d):
    return T.cluster_bootstrap(rows(spark, d), BY, "score", "group_id", "row_id", nboot=10_000)


@query()
def interval_variances(spark, d):
    c = T.cluster_bootstrap(rows(spark, d), ["dataset"], "score", "group_id", "row_id", nboot=10_000)
    return c.select("dataset", T.variance_from_interval(F.col("lo"), F.col("hi")).alias("variance"), T.interval_verdict(F.col("lo"), F.col("hi")).alias("verdict"))


ARMS = """a AS (SELECT dataset, item_id, avg(score) AS a, min(group_id) AS ga FROM result_items WHERE backbone = 'meralion-2-gguf' AND score IS NOT NULL GROUP BY ALL),
b AS (SELECT dataset, item_id, avg(score) AS b, min(group_id) AS gb FROM result_items WHERE backbone = 'qwen3-omni-30b-gguf' AND score IS NOT NULL GROUP BY ALL)"""


def arms(spark, d):
    """Two backbones' mean scores of the items both have."""
    one = lambda m, s, g: rows(spark, d).where((F.col("backbone") == m) & F.col("score").isNotNull()).groupBy("dataset", "item_id").agg(F.avg("score").alias(s), F.min("group_id").alias(g))
    j = one("meralion-2-gguf", "a", "ga").join(one("qwen3-omni-30b-gguf", "b", "gb"), ["dataset", "item_id"])
    return j.select("dataset", "item_id", "a", "b", F.coalesce("ga", "gb").alias("grp"))


@query(f"WITH {ARMS} SELECT dataset, count(*) AS n, round(avg(a - b), 6) AS delta, round(avg(b) FILTER (WHERE a = 0), 6) AS rescue FROM a JOIN b USING (dataset, item_id) GROUP BY 1")
def paired_arms(spark, d):
    return arms(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"), F.round(F.avg(F.when(F.col("a") == 0, F.col("b"))), 6).alias("rescue"))


@query()
def paired_intervals(spark, d):
    return T.paired_bootstrap(arms(spark, d), ["dataset"], "a", "b", "grp", "item_id", nboot=10_000)


@query()
def max_t_adjusted(spark, d):
    return T.max_t(arms(spark, d).withColumn("family", F.lit("all")), "family", "dataset", "a", "b", "grp", nboot=10_000)


@query()
def nested_interval(spark, d):
    return T.nested_bootstrap(rows(spark, d), "dataset", "score", "group_id", "row_id", nboot=2_000)


@query()
def index_intervals(spark, d):
    return T.index_bootstrap(rows(spark, d), ["dataset"], "score", "group_id", "row_id", nboot=2_000)


# -- selectors, windows, rendering -----------------------------------------------------------------------------------


@query(f"""WITH {POOL}, t AS (SELECT dataset, item_id, reply, count(*) AS m FROM c WHERE reply IS NOT NULL GROUP BY ALL), s AS (SELECT dataset, item_id, sum(m)::BIGINT AS n, sum(m * (m - 1)) AS same FROM t GROUP BY ALL)
SELECT dataset, item_id, n, round(CASE WHEN n > 1 THEN same / (n * (n - 1)) ELSE 1 END, 6) AS rate, CASE WHEN n > 1 THEN same / (n * (n - 1)) ELSE 1 END < 0.6 AS triggered FROM s""")
def agreement_trigger(spark, d):
    a = L.agreement(pool(spark, d), ["dataset", "item_id"], "reply")
    return a.select("dataset", "item_id", "n", F.round("rate", 6).alias("rate"), "triggered")


@query()
def consensus_pick(spark, d):
    u = L.consensus(pool(spark, d), ["dataset", "item_id"], "reply")
    return L.pick(u, ["dataset", "item_id"], "utility")


@query(f"""WITH {POOL}, v AS (SELECT dataset, item_id, reply, sum(exp(score)) AS w, min(idx) AS i FROM c WHERE reply IS NOT NULL GROUP BY ALL)
SELECT dataset, item_id, reply, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dataset, item_id ORDER BY w DESC, i) AS r FROM v) WHERE r = 1""")
def confidence_vote(spark, d):
    p = pool(spark, d).withColumn("w", F.exp("score"))
    return L.weighted_vote(p, ["dataset", "item_id"], "reply", "w").select("dataset", "item_id", "reply", F.round("weight", 6).alias("weight"))


@query(f"WITH {POOL} SELECT dataset, item_id, (arg_max(idx, length(reply) * 1000 - idx))::INT AS idx FROM c WHERE reply IS NOT NULL GROUP BY ALL")
def longest_pick(spark, d):
    p = pool(spark, d).where("reply is not null").withColumn("n", F.length("reply"))
    return L.pick(p, ["dataset", "item_id"], "n")


def _memory_input(spark, d):
    """Speakers are groups, a session's steps its items in order, the pool the item's first eight rows."""
    p = pool(spark, d).where("idx < 8 and group_id is not null").select("group_id", "item_id", "row_id", "idx", "reply")
    p = p.withColumn("step", F.concat_ws("|", "item_id"))
    rare = L.rare_tokens(p, ["row_id"], "reply", most=50)
    from quillon.functions.text import speech_tokens

    z = L.z_scores(p.withColumn("n_tokens", F.size(speech_tokens(F.coalesce("reply", F.lit(""))))), ["group_id", "step"], "n_tokens")
    return z.join(rare, "row_id").select("group_id", "step", "idx", "z", "n_tokens", "rare")


@query()
def memory_set(spark, d):
    return L.memory_select(_memory_input(spark, d), "group_id", "step", "set", 0.2, 2)


@query()
def memory_near(spark, d):
    return L.memory_select(_memory_input(spark, d), "group_id", "step", "near", 0.2)


@query()
def memory_count(spark, d):
    return L.memory_select(_memory_input(spark, d), "group_id", "step", "count", 0.5)


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, event_id, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)))::INT AS n_past FROM e""".replace("len(list_distinct(list(", "coalesce(len(list_distinct(list(").replace("))::INT", ")), 0)::INT"))
def past_memory(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("v"))
    return L.past_union(e, "user_id", "event_id", "v", 5).select("user_id", "event_id", F.size("past").alias("n_past"))


@query("""
WITH m AS (SELECT dataset, count(*) AS n FROM result_items GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY dataset) - 1 AS i, count(*) OVER () AS k FROM m)
SELECT a.dataset, b.dataset AS donor, b.n FROM o a JOIN o b ON b.i = (a.i + 1) % a.k""")
def derangement_join(spark, d):
    return L.derangement(rows(spark, d).groupBy("dataset").agg(F.count("*").alias("n")), "dataset", "n")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE event_type <> 'view' GROUP BY user_id, event_type, g""")
def label_spans(spark, d):
    return L.spans(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", "view")


@query(f"WITH {POOL} SELECT row_id, CASE WHEN s > 0 THEN round((n - m) / s, 6) ELSE 0 END AS z FROM (SELECT row_id, length(reply) AS n, avg(length(reply)) OVER p AS m, stddev_pop(length(reply)) OVER p AS s FROM c WHERE reply IS NOT NULL WINDOW p AS (PARTITION BY dataset, item_id))")
def pool_z_scores(spark, d):
    p = pool(spark, d).where("reply is not null").withColumn("n", F.length("reply"))
    return L.z_scores(p, ["dataset", "item_id"], "n").select("row_id", F.round("z", 6).alias("z"))


@query("""
WITH r AS (SELECT source, card_id, row_number() OVER (PARTITION BY source ORDER BY relevance_signal.sim DESC NULLS LAST, card_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM knowledge_cards)
SELECT source, card_id, (CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - (r - 1) // 2 END)::INT AS position FROM r""")
def edge_positions(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("relevance_signal.sim"), "card_id")
    k = table(spark, d, "knowledge_cards").withColumn("r", F.row_number().over(w) - 1)
    return L.edge_reorder(k, "source", "r").select("source", "card_id", "position")


@query("SELECT card_id, CASE WHEN relevance_signal.sim >= 0.85 THEN 'high' WHEN relevance_signal.sim >= 0.6 THEN 'medium' WHEN relevance_signal.sim IS NOT NULL THEN 'low' END AS band FROM knowledge_cards")
def card_bands(spark, d):
    return table(spark, d, "knowledge_cards").select("card_id", render.band(F.col("relevance_signal.sim")).alias("band"))


@query("""
SELECT card_id, '[knowledge-card v' || schema_version || ' | ' || source_tag || ' | relevance=' || CASE WHEN relevance_signal.sim >= 0.85 THEN 'high' WHEN relevance_signal.sim >= 0.6 THEN 'medium' ELSE 'low' END
 || ' sim=' || printf('%.3f', relevance_signal.sim) || ' rank=' || relevance_signal.rank || ']' || chr(10) || coalesce(content, '') || chr(10) || 'usage_directive: ' || coalesce(usage_directive, '') AS card FROM knowledge_cards WHERE relevance_signal.sim IS NOT NULL""")
def rendered_cards(spark, d):
    k = table(spark, d, "knowledge_cards").where("relevance_signal.sim is not null")
    c = F.col
    return k.select("card_id", render.card(c("schema_version"), c("source_tag"), c("relevance_signal.sim"), c("relevance_signal.rank"), c("content"), c("usage_directive")).alias("card"))


@query()
def delivered_prompts(spark, d):
    from quillon.plans.retrieval_queries import bm25_docs

    docs = table(spark, d, "documents").select("doc_id", "text")
    e = table(spark, d, "eval_items").select(F.col("eval_id").alias("query_id"), "question")
    h = L.edge_reorder(bm25_docs(spark, d, 3), "query_id", "rank").join(docs, "doc_id").join(e, "query_id")
    h = h.withColumn("passage", render.compress(F.col("text"), F.col("question")))
    return render.delivery(h, "query_id", "position", "passage", F.col("question"))
