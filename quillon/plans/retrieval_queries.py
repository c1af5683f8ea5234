"""Retrieval, audits and governed tables as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import dot, norm, pseudo_questions
from quillon.operators import audit as A
from quillon.operators import retrieval as R
from quillon.plans.registry import query
from quillon.plans.runtime import table

# White space for the SQL side, whose \\s knows ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def split_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '{WS}'), lambda x: x <> '')"


def bm25_sql(k: int) -> str:
    return f"""
d AS (SELECT doc_id, {split_sql('text')} AS t FROM documents),
q AS (SELECT eval_id AS query_id, unnest({split_sql('question')}) AS term FROM eval_items),
s AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, greatest(len(t), 1) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
 FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM sc) WHERE rank < {k})"""



def bm25_docs(spark, d, k):
    return R.bm25_top(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "eval_id", "question", k)


@query(f"WITH {bm25_sql(5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return bm25_docs(spark, d, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_hits(spark, d, k, **kw):
    """Every vector whose id is divisible by 50 against all vectors."""
    v = table(spark, d, "embeddings")
    return R.vector_top(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), "vec_id", "embedding", k, **kw)


def sim_sql(k: int) -> str:
    return f"""
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim, a.label AS ql, b.label AS vl
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
h AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) - 1)::INT AS rank FROM p) WHERE rank < {k})"""



@query(f"WITH {sim_sql(10)} SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM h")
def vec_topk(spark, d):
    return vec_hits(spark, d, 10, exclude_self=True).select("query_id", "vec_id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {sim_sql(10)} SELECT query_id, vec_id, rank FROM h WHERE sim >= 0.3")
def vec_threshold(spark, d):
    return vec_hits(spark, d, 10, exclude_self=True, min_sim=0.3).select("query_id", "vec_id", "rank")


@query(f"WITH {sim_sql(10)} SELECT query_id, vec_id, rank FROM (SELECT *, max(sim) OVER (PARTITION BY query_id) AS m FROM h) WHERE sim >= 0.9 * m OR rank = 0")
def vec_gate(spark, d):
    return R.gate(vec_hits(spark, d, 10, exclude_self=True)).select("query_id", "vec_id", "rank")


@query(f"WITH {sim_sql(1)} SELECT query_id, vec_id FROM h")
def vec_select_first(spark, d):
    return vec_hits(spark, d, 10, exclude_self=True).where("rank = 0").select("query_id", "vec_id")


@query(f"WITH {sim_sql(50)} SELECT query_id, count(*) AS n, round(min(sim), 6) AS least FROM h GROUP BY 1")
def vec_stuffing(spark, d):
    return vec_hits(spark, d, 50, exclude_self=True).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("sim"), 6).alias("least"))


@query(f"WITH {sim_sql(5)} SELECT ql AS label, count(*) AS n, round(avg((ql = vl)::INT), 6) AS precision_at_5 FROM h GROUP BY 1")
def knn_precision(spark, d):
    h = vec_hits(spark, d, 5, exclude_self=True)
    v = table(spark, d, "embeddings")
    ql, vl = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), v.select("vec_id", F.col("label").alias("vl"))
    return h.join(ql, "query_id").join(vl, "vec_id").groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("ql") == F.col("vl")).cast("int")), 6).alias("precision_at_5"))


@query("SELECT round(sum(power(n / t, 2)), 6) AS chance FROM (SELECT count(*) AS n FROM embeddings GROUP BY label), (SELECT count(*) AS t FROM embeddings)")
def chance_rate(spark, d):
    v = table(spark, d, "embeddings")
    return v.groupBy("label").agg(F.count("*").alias("n")).crossJoin(v.agg(F.count("*").alias("t"))).agg(F.round(F.sum(F.pow(F.col("n") / F.col("t"), F.lit(2))), 6).alias("chance"))


@query("""
WITH m AS (SELECT label, p, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY p) AS v FROM m GROUP BY label), n AS (SELECT label, v, sqrt(list_dot_product(v, v)) AS l FROM c),
k AS (SELECT * FROM (SELECT a.vec_id AS query_id, a.embedding::DOUBLE[] AS e, n.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], v) / l, 9) DESC, n.label) AS r
 FROM embeddings a, n WHERE a.vec_id % 50 = 0) WHERE r <= 2),
s AS (SELECT query_id, b.vec_id, round(list_dot_product(e, b.embedding::DOUBLE[]), 9) AS sim FROM k JOIN embeddings b USING (label))
SELECT query_id, vec_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) - 1)::INT AS rank FROM s) WHERE rank < 5""")
def vec_two_stage(spark, d):
    v = table(spark, d, "embeddings")
    return R.two_stage(v, "vec_id", "embedding", "label", v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@query()
def vec_clustered_two_stage(spark, d):
    """Clusters fitted on a sample instead of given labels."""
    v = R.assign_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return R.two_stage(v, "vec_id", "embedding", "cluster", v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, coarse=None)


@query(f"""
WITH {bm25_sql(20)}, dn AS (SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1)::INT AS rank FROM bm WHERE rank % 2 = 0),
f AS (SELECT query_id, doc_id AS id, round(coalesce(1.0::DOUBLE / (61 + dn.rank), 0) + coalesce(1.0::DOUBLE / (61 + bm.rank), 0), 9) AS score FROM dn FULL JOIN bm USING (query_id, doc_id))
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS rank FROM f) WHERE rank < 5""")
def rrf_hybrid(spark, d):
    """Two rankings of the same documents fused; the second one is the even ranks in order of id."""
    from pyspark.sql.window import Window

    bm = bm25_docs(spark, d, 20).withColumnRenamed("doc_id", "id")
    other = bm.where("rank % 2 = 0").withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1).cast("int"))
    return R.fuse(other, bm, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


HOPS = f"""{bm25_sql(5)},
q2 AS (SELECT e.eval_id AS query_id, unnest({split_sql("concat_ws(' ', e.question, o.text)")}) AS term FROM eval_items e LEFT JOIN bm ON bm.query_id = e.eval_id AND bm.rank = 0 LEFT JOIN documents o USING (doc_id)),
g2 AS (SELECT query_id, term, count(*) AS qtf FROM q2 GROUP BY ALL), tf2 AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, greatest(len(t), 1) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM g2) GROUP BY ALL),
df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term),
sc2 AS (SELECT query_id, doc_id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf), 9) AS score FROM tf2 JOIN df2 USING (term) JOIN g2 USING (term), s GROUP BY ALL),
b2 AS (SELECT * FROM (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM sc2) WHERE rank < 5),
u AS (SELECT 1 AS hop, query_id, doc_id, score, rank FROM bm UNION ALL SELECT 2, query_id, doc_id, score, rank FROM b2),
k AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hop, rank) AS r FROM u) WHERE r = 1)"""


@query(f"WITH {HOPS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM k) WHERE rank < 5")
def two_hop_search(spark, d):
    h = R.two_hop(bm25_docs(spark, d, 5), table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "eval_id", "question", 5)
    return h.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {bm25_sql(10)}, g AS (SELECT eval_id AS query_id, doc_id FROM eval_items JOIN documents ON contains(lower(text), lower(detail.gold)) WHERE length(detail.gold) >= 40),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), f AS (SELECT query_id, count(*) AS h, sum(1 / log2(rank + 2)) AS dcg FROM bm JOIN g USING (query_id, doc_id) GROUP BY 1)
SELECT query_id, coalesce((h > 0)::INT, 0) AS hit, round(coalesce(h / n, 0), 6) AS recall,
 round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: ln(2) / ln(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN f USING (query_id)""")
def retrieval_quality(spark, d):
    """Recall and nDCG at 10 of BM25 against the documents that hold an item's long gold."""
    e = table(spark, d, "eval_items").where("length(detail.gold) >= 40")
    g = A.containment(table(spark, d, "documents"), "doc_id", F.lower("text"), e, "eval_id", F.lower("detail.gold")).select(F.col("gold_id").alias("query_id"), F.col("entry_id").alias("id"))
    h = R.ndcg(bm25_docs(spark, d, 10).withColumnRenamed("doc_id", "id"), g, 10)
    return h.select("query_id", "hit", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


TFIDF = f"""
t AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest({split_sql('text')}) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, f * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM t, n),
v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query(f"WITH {TFIDF} SELECT doc_id, count(*) AS n_terms, round(max(weight), 6) AS top_weight, round(sum(weight), 4) AS total FROM v GROUP BY doc_id")
def tf_idf_vectors(spark, d):
    v = R.tf_idf(table(spark, d, "documents"), "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 4).alias("total"))


@query("""
SELECT kind, k, CASE WHEN kind = 'long-context-stuffing' THEN 50 WHEN kind IN ('retrieve-then-select', 'two-stage') THEN greatest(4 * k, 10) ELSE k END AS pool
FROM (SELECT unnest(['dense-topk', 'fixed-threshold', 'retrieve-then-select', 'long-context-stuffing', 'hybrid-bm25-dense-rrf', 'two-stage', 'ircot-2hop']) AS kind, 5 AS k)""")
def retrieval_pools(spark, d):
    kinds = ("dense-topk", "fixed-threshold", "retrieve-then-select", "long-context-stuffing", "hybrid-bm25-dense-rrf", "two-stage", "ircot-2hop")
    k = spark.createDataFrame([(x, 5) for x in kinds], "kind string, k int")
    return k.withColumn("pool", R.pool_size(F.col("kind"), 5))


# -- audits ----------------------------------------------------------------------------------------------------------

HELD = "SELECT eval_id, lower(detail.gold) AS g FROM eval_items WHERE detail.gold <> ''"


def _held(spark, d):
    return table(spark, d, "eval_items").withColumn("g", F.lower("detail.gold")).where("g <> ''")


def _leaks(spark, d):
    return A.containment(table(spark, d, "knowledge_cards"), "card_id", F.lower("content"), _held(spark, d), "eval_id", F.col("g"))


@query(f"SELECT eval_id AS gold_id, card_id AS entry_id FROM ({HELD}) JOIN knowledge_cards ON contains(lower(content), g)")
def leak_entries(spark, d):
    return _leaks(spark, d)


@query(f"""
WITH h AS ({HELD}), f AS (SELECT DISTINCT eval_id FROM h JOIN knowledge_cards ON contains(lower(content), g)), n AS (SELECT count(*) AS n_golds, count(f.eval_id) AS n_leaked FROM h LEFT JOIN f USING (eval_id))
SELECT n_golds, n_leaked, round(n_leaked / n_golds, 3) AS overlap_rate, CASE WHEN n_leaked / n_golds >= 0.5 THEN 'LEAKAGE' WHEN n_leaked > 0 THEN 'SUSPECT' ELSE 'CLEAN' END AS verdict FROM n""")
def leak_overlap(spark, d):
    return A.overlap_audit(_leaks(spark, d), _held(spark, d), "eval_id")


def norm_sql(t: str) -> str:
    kept = WS[1:-2]
    return rf"regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}{kept}]', '', 'g'), '^{WS}|{WS}$', '', 'g')"




def grams_sql(w: str) -> str:
    return f"CASE WHEN len({w}) = 0 THEN []::VARCHAR[] WHEN len({w}) < 8 THEN [array_to_string({w}, ' ')] ELSE list_transform(range(1, len({w}) - 6), lambda i: array_to_string({w}[i:i+7], ' ')) END"



@query(f"""
WITH g AS (SELECT eval_id, {split_sql(norm_sql('detail.gold'))} AS w FROM eval_items), c AS (SELECT {split_sql(norm_sql('content'))} AS w FROM knowledge_cards WHERE content IS NOT NULL),
gg AS (SELECT eval_id AS gold_id, unnest(list_distinct({grams_sql('w')})) AS gram FROM g), cg AS (SELECT DISTINCT unnest({grams_sql('w')}) AS gram FROM c)
SELECT gold_id, count(*) AS n_grams, count(cg.gram) AS n_found, round(count(cg.gram) / count(*), 3) AS overlap FROM gg LEFT JOIN cg USING (gram) GROUP BY 1""")
def ngram_contain(spark, d):
    return A.ngram_overlap(table(spark, d, "knowledge_cards"), F.col("content"), table(spark, d, "eval_items"), "eval_id", F.col("detail.gold"))


@query()
def scrub_and_reaudit(spark, d):
    """The cards scrubbed of all golds, audited again."""
    held = _held(spark, d).withColumn("gold", F.col("detail.gold"))
    clean = A.scrubbed(table(spark, d, "knowledge_cards"), "content", held, "gold")
    return A.overlap_audit(A.containment(clean, "card_id", F.lower("content"), held, "eval_id", F.col("g")), held, "eval_id")


@query(f"WITH {sim_sql(1)} SELECT count(*) AS n_golds, count(*) FILTER (WHERE sim >= 0.9) AS n_near, round(avg((sim >= 0.9)::INT), 3) AS near_rate, CASE WHEN avg((sim >= 0.9)::INT) >= 0.5 THEN 'LEAKAGE' WHEN avg((sim >= 0.9)::INT) > 0 THEN 'SUSPECT' ELSE 'CLEAN' END AS verdict FROM h")
def similarity_audit(spark, d):
    return A.max_similarity_audit(vec_hits(spark, d, 1, exclude_self=True))


@query()
def corpus_lock(spark, d):
    return A.corpus_lock(table(spark, d, "documents"), ["source"], "doc_id", "text")


@query("SELECT source, true AS verified, '' AS mismatches FROM documents GROUP BY source")
def corpus_lock_verify(spark, d):
    docs = table(spark, d, "documents")
    return A.verify_lock(A.corpus_lock(docs, ["source"], "doc_id", "text"), A.corpus_lock(docs.repartition(7), ["source"], "doc_id", "text"), ["source"])


@query("""
WITH a AS (SELECT source, 'object_correct' AS axis, CASE WHEN count(content) > 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM knowledge_cards GROUP BY 1
 UNION ALL SELECT source, 'provenance_complete', CASE WHEN count(source_tag) = count(*) THEN 'PASS' ELSE 'FAIL' END FROM knowledge_cards GROUP BY 1
 UNION ALL SELECT source, 'answer_presence', CASE WHEN count(relevance_signal.sim) < count(*) THEN 'NOT_EVALUATED' ELSE 'PASS' END FROM knowledge_cards GROUP BY 1),
s AS (SELECT source, string_agg(axis, ',' ORDER BY axis) FILTER (WHERE state = 'FAIL') AS f, string_agg(axis, ',' ORDER BY axis) FILTER (WHERE state = 'NOT_EVALUATED') AS n FROM a GROUP BY 1)
SELECT source, CASE WHEN f IS NOT NULL THEN 'FAIL(' || f || ')' WHEN n IS NOT NULL THEN 'PASS-with-NOT_EVALUATED(' || n || ')' ELSE 'CLEAN' END AS overall FROM s""")
def corpus_axes(spark, d):
    k = table(spark, d, "knowledge_cards").groupBy("source").agg(F.count("*").alias("n"), F.count("content").alias("c"), F.count("source_tag").alias("t"), F.count("relevance_signal.sim").alias("s"))
    state = lambda axis, x: F.struct(F.lit(axis).alias("axis"), x.alias("state"))
    axes = k.select("source", F.explode(F.array(
        state("object_correct", F.when(F.col("c") > 0, "PASS").otherwise("FAIL")), state("provenance_complete", F.when(F.col("t") == F.col("n"), "PASS").otherwise("FAIL")),
        state("answer_presence", F.when(F.col("s") < F.col("n"), "NOT_EVALUATED").otherwise("PASS")),
    )).alias("a")).select("source", "a.axis", "a.state")
    return A.corpus_axes(axes)


@query("SELECT source, count(*) AS n, count(content) AS n_content, count(DISTINCT content) AS n_distinct, round(avg(length(content)), 6) AS mean_chars FROM knowledge_cards GROUP BY 1")
def content_inventory(spark, d):
    return A.content_inventory(table(spark, d, "knowledge_cards"), "source", "content").withColumn("mean_chars", F.round("mean_chars", 6))


@query()
def pseudo_question_keys(spark, d):
    """Keys of question lists: at most five questions a document, each with the document it came from."""
    q = table(spark, d, "documents").where("doc_kind = 'qa' and text is not null")
    return q.select("doc_id", F.posexplode(pseudo_questions(F.col("text"), 5)).alias("pqi", "question")).select(F.format_string("%d|%d", "doc_id", "pqi").alias("key_id"), F.col("doc_id").alias("parent_id"), "question")


@query("SELECT card_id, left(sha1(kid || '|' || source || '|' || schema_version::VARCHAR), 16) AS build_hash FROM knowledge_cards")
def build_hashes(spark, d):
    return table(spark, d, "knowledge_cards").select("card_id", F.substring(F.sha1(F.concat_ws("|", "kid", "source", F.col("schema_version").cast("string"))), 1, 16).alias("build_hash"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding)::INT AS dim FROM embeddings")
def vector_contract(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.size("embedding").alias("dim"))


@query("""
WITH g AS (SELECT source, coalesce(regexp_extract(source_tag, 'key_modality=(\\S+)', 1), '') AS m, coalesce(regexp_extract(source_tag, 'value_type=(\\S+)', 1), '') AS t FROM knowledge_cards)
SELECT source, m, t, count(*) AS n FROM g GROUP BY GROUPING SETS ((source), (m), (t))""".replace("\\\\", "\\"))
def registry_summary(spark, d):
    get = lambda k: F.coalesce(F.regexp_extract("source_tag", k + r"=(\S+)", 1), F.lit(""))
    k = table(spark, d, "knowledge_cards").select("source", get("key_modality").alias("m"), get("value_type").alias("t"))
    return k.groupingSets([["source"], ["m"], ["t"]], "source", "m", "t").agg(F.count("*").alias("n"))


@query(f"SELECT {norm_sql('question')} AS q, count(*) AS n FROM eval_items GROUP BY 1")
def normalized_questions(spark, d):
    return table(spark, d, "eval_items").groupBy(norm(F.col("question")).alias("q")).agg(F.count("*").alias("n"))
