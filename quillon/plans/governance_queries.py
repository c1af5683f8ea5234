"""Gates of knowledge sources, control arms, and sources and sinks written and read back, as queries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from quillon.functions.text import class_by_prefix
from quillon.operators import audit as A
from quillon.operators import governance as V
from quillon.operators import grid as J
from quillon.operators import retrieval as R
from quillon.plans.measure_queries import rows
from quillon.plans.registry import ORACLES, query
from quillon.plans.retrieval_queries import sim_sql
from quillon.plans.runtime import _path, checkpoint_dir, cut, table
from quillon.sources import scans as S
from quillon.sources import sinks as K


def workspace(spark) -> str:
    """A folder of its own in the shared checkpoint folder, removed when the application ends."""
    path = f"{checkpoint_dir(spark)}/quillon-io-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


# -- gates -----------------------------------------------------------------------------------------------------------

HELD = "h AS (SELECT eval_id, lower(detail.gold) AS g FROM eval_items WHERE detail.gold <> '')"
GATE = f"""{HELD}, f AS (SELECT k.source, count(DISTINCT h.eval_id) AS n_leaked FROM h JOIN knowledge_cards k ON contains(lower(k.content), h.g) GROUP BY 1), n AS (SELECT count(*) AS n_golds FROM h),
v AS (SELECT s.source, n_golds, coalesce(n_leaked, 0) AS n_leaked FROM (SELECT DISTINCT source FROM knowledge_cards) s LEFT JOIN f USING (source), n)"""
VERDICT = "CASE WHEN n_leaked / n_golds >= 0.5 THEN 'LEAKAGE' WHEN n_leaked > 0 THEN 'SUSPECT' ELSE 'CLEAN' END"


def _audited(spark, d, cards):
    held = table(spark, d, "eval_items").withColumn("g", F.lower("detail.gold")).where("g <> ''")
    return V.audited(cards, "card_id", F.lower("content"), held, "eval_id", F.col("g"))


@query(f"WITH {GATE} SELECT source, n_golds, n_leaked, round(n_leaked / n_golds, 3) AS overlap_rate, {VERDICT} AS verdict FROM v")
def source_audit(spark, d):
    return _audited(spark, d, table(spark, d, "knowledge_cards"))


@query(f"""WITH {GATE}, k AS (SELECT source, count(*) AS n_values FROM knowledge_cards GROUP BY 1)
SELECT 'clean' AS part, coalesce(sum(n_values) FILTER (WHERE {VERDICT} = 'CLEAN'), 0)::BIGINT AS n_values, true AS admitted FROM v JOIN k USING (source)
UNION ALL SELECT 'others', coalesce(sum(n_values) FILTER (WHERE {VERDICT} <> 'CLEAN'), 0)::BIGINT, false FROM v JOIN k USING (source)""")
def source_gate(spark, d):
    """The cards of clean sources and of all others, persisted as two versions and loaded again: the second is refused."""
    cards = table(spark, d, "knowledge_cards")
    verdicts = cut(_audited(spark, d, cards))
    base, out = workspace(spark), []
    for part, verdict, cond in (("clean", "CLEAN", "verdict = 'CLEAN'"), ("others", "SUSPECT", "verdict <> 'CLEAN'")):
        V.persist_source(cards.join(F.broadcast(verdicts.where(cond).select("source")), "source"), f"{base}/{part}", verdict)  # a row per source
        try:
            values, _ = V.load_source(spark, f"{base}/{part}")
            admitted = True
        except V.Refused:
            values, _ = V.load_source(spark, f"{base}/{part}", allow_unclean=True)
            admitted = False
        out.append(values.agg(F.count("*").alias("n_values")).select(F.lit(part).alias("part"), "n_values", F.lit(admitted).alias("admitted")))
    return out[0].union(out[1])


ROUTED = "CASE WHEN m = 'text' THEN 'same' WHEN e = 'clap' THEN 'cross' WHEN e = 'glap' THEN 'refused: pending' ELSE 'refused: unknown' END"


@query(f"WITH k AS (SELECT card_id, coalesce(regexp_extract(source_tag, 'key_modality=([^ ]+)', 1), '') AS m, string_split(source, '__')[2] AS e FROM knowledge_cards) SELECT card_id, {ROUTED} AS route FROM k")
def routes(spark, d):
    k = table(spark, d, "knowledge_cards").select("card_id", F.coalesce(F.regexp_extract("source_tag", r"key_modality=([^ ]+)", 1), F.lit("")).alias("m"), F.split("source", "__")[1].alias("e"))
    return k.select("card_id", V.routed(F.col("m"), F.lit("text"), F.coalesce("e", F.lit(""))).alias("route"))


@query("SELECT source, CASE WHEN starts_with(source, 'massive-d') THEN 'de' WHEN starts_with(source, 'massive-') THEN 'massive' WHEN starts_with(source, 'squad') THEN 'squad' ELSE 'other' END AS family, count(*) AS n FROM knowledge_cards GROUP BY ALL")
def source_families(spark, d):
    return table(spark, d, "knowledge_cards").groupBy("source", class_by_prefix(F.col("source"), {"massive-": "massive", "massive-d": "de", "squad": "squad"}, "other").alias("family")).agg(F.count("*").alias("n"))


# -- control arms ----------------------------------------------------------------------------------------------------

DRAWN = """p AS (SELECT card_id AS id, row_number() OVER (ORDER BY sha256('7:' || card_id), card_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT card_id FROM knowledge_cards)),
q AS (SELECT eval_id AS query_id, ('0x' || left(sha256('7:query:' || eval_id), 13))::BIGINT AS s FROM eval_items),
r AS (SELECT query_id, id, k::INT AS rank FROM q, (SELECT unnest(range(3)) AS k), (SELECT max(n) AS n FROM p) m JOIN p ON true WHERE p.place = (s + k) % m.n)"""
JUDGED = f"{HELD}, j AS (SELECT DISTINCT eval_id AS query_id, card_id AS id FROM h JOIN knowledge_cards ON contains(lower(content), g))"
FIRST = "o AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY id) - 1)::INT AS rank FROM j) WHERE rank < 3), w AS (SELECT query_id, min(id) AS id FROM j GROUP BY 1)"


@query(f"""WITH {DRAWN}, {JUDGED}, {FIRST} SELECT 'random' AS arm, r.* FROM r ANTI JOIN w USING (query_id, id) UNION ALL SELECT 'oracle', o.* FROM o ANTI JOIN w USING (query_id, id) UNION ALL SELECT 'own', query_id, id, 0 FROM w""")
def control_arms(spark, d):
    """Random and judged cards for every question, and the first card that holds its gold as its own."""
    e, cards = table(spark, d, "eval_items"), table(spark, d, "knowledge_cards")
    held = e.withColumn("g", F.lower("detail.gold")).where("g <> ''")
    gold = cut(A.containment(cards, "card_id", F.lower("content"), held, "eval_id", F.col("g")).select(F.col("gold_id").alias("query_id"), F.col("entry_id").alias("id")))
    own = gold.groupBy("query_id").agg(F.min("id").alias("id"))
    return R.control_arms(e, "eval_id", cards, "card_id", gold, own, 3, 7)


ORACLES["vec_clustered_two_stage"] = """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) - 1)::INT AS rank FROM p) WHERE rank < 5"""
ORACLES["scrub_and_reaudit"] = "SELECT count(*) AS n_golds, 0::BIGINT AS n_leaked, 0.0::DOUBLE AS overlap_rate, 'CLEAN' AS verdict FROM eval_items WHERE detail.gold <> ''"
ORACLES["ablation_arms"] = """
SELECT * FROM (SELECT DISTINCT dataset FROM result_items), (VALUES ('base', 'dense-topk', '5', 'flat', 'transcript'), ('kind=fixed-threshold', 'fixed-threshold', '5', 'flat', 'transcript'),
 ('kind=hybrid-bm25-dense-rrf', 'hybrid-bm25-dense-rrf', '5', 'flat', 'transcript'), ('kind=two-stage', 'two-stage', '5', 'flat', 'transcript'), ('k=1', 'dense-topk', '1', 'flat', 'transcript'),
 ('k=20', 'dense-topk', '20', 'flat', 'transcript'), ('delivery=structured-ref', 'dense-topk', '5', 'structured-ref', 'transcript'),
 ('delivery=relevance-edge-reorder', 'dense-topk', '5', 'relevance-edge-reorder', 'transcript'), ('query=audio', 'dense-topk', '5', 'flat', 'audio')) v(arm, kind, k, delivery, query)"""
ORACLES["pseudo_question_keys"] = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_kind = 'qa' AND text IS NOT NULL),
u AS (SELECT doc_id, trim(regexp_replace(unnest(ls), '^[ \t\n\r\f\v]*(?:[-*•]|[0-9]+[.)、])[ \t\n\r\f\v]*', '')) AS q, generate_subscripts(ls, 1) AS i FROM l),
m AS (SELECT doc_id, q, min(i) AS i FROM u WHERE q <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM m)
SELECT doc_id || '|' || p AS key_id, doc_id AS parent_id, q AS question FROM n WHERE p < 5"""


@query(f"WITH {sim_sql(50)} SELECT kind, query_id, vec_id, rank FROM (SELECT 'dense-topk' AS kind, * FROM h WHERE rank < 5 UNION ALL SELECT 'fixed-threshold', * FROM h WHERE rank < 5 AND sim >= 0.3 UNION ALL SELECT 'long-context-stuffing', * FROM h)")
def retrieval_kinds(spark, d):
    """Three kinds of retrieval through the one dispatcher."""
    from quillon.plans.retrieval_queries import vec_hits

    dense = lambda k: vec_hits(spark, d, k, exclude_self=True)
    parts = [R.retrieve(kind, 5, dense).select(F.lit(kind).alias("kind"), "query_id", "vec_id", "rank") for kind in ("dense-topk", "fixed-threshold", "long-context-stuffing")]
    return parts[0].union(parts[1]).union(parts[2])


# -- sources and sinks -----------------------------------------------------------------------------------------------

CELL_COUNTS = "SELECT dataset, backbone, split, count(*) AS n FROM result_items GROUP BY ALL"


@query(CELL_COUNTS)
def io_cells(spark, d):
    """Result rows written by cell and read back; a second write replaces only the cells it holds."""
    path = workspace(spark) + "/cells"
    r = rows(spark, d).select("dataset", "backbone", "split", "row_id")
    K.write_cells(r, path)
    K.write_cells(r.where("backbone = 'meralion-2-gguf'"), path)
    return S.parquet(spark, path, ["dataset", "backbone", "split"]).groupBy("dataset", "backbone", "split").agg(F.count("*").alias("n"))


@query("SELECT eval_id, question FROM eval_items WHERE question IS NOT NULL")
def io_json_lines(spark, d):
    """An append-only log of JSON lines, written in two parts and read with its schema."""
    path = workspace(spark) + "/log"
    e = table(spark, d, "eval_items").select("eval_id", "question").where("question is not null")
    K.append_log(e.where("eval_id % 2 = 0"), path)
    K.append_log(e.where("eval_id % 2 = 1"), path)
    return S.json_lines(spark, path, "eval_id bigint, question string")


@query("SELECT source, target_share, max_repeats FROM mix_targets")
def io_csv(spark, d):
    path = workspace(spark) + "/csv"
    table(spark, d, "mix_targets").write.option("header", True).csv(path)
    return S.csv(spark, path, "source string, target_share double, max_repeats int")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def io_tab_rows(spark, d):
    """Lines of two fields among lines of one and three, which are left out."""
    path = workspace(spark) + "/tab"
    n = table(spark, d, "nation")
    line = lambda *c: F.concat_ws("\t", *c).alias("value")
    key = F.col("n_nationkey").cast("string")
    n.select(line(key, F.col("n_name"))).union(n.select(line(key))).union(n.select(line(key, F.col("n_name"), key))).write.text(path)
    return S.tab_rows(spark, path, ["key", "name"])


@query("SELECT stage, count(*) AS n FROM result_cells GROUP BY 1")
def io_json_array(spark, d):
    path = workspace(spark) + "/array"
    c = table(spark, d, "result_cells").select("stage", "cell_id")
    parts = c.groupBy("stage").agg(F.to_json(F.collect_list(F.struct("stage", "cell_id"))).alias("value"))  # a file per stage of a run list
    parts.select("value").repartition("value").write.text(path)
    return S.json_array(spark, path, "stage string, cell_id bigint").groupBy("stage").agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents WHERE n_chars > 1000")
def io_late_columns(spark, d):
    """Texts fetched only for the documents chosen by their size."""
    return S.late_materialized(spark, f"{d}/documents.parquet", "doc_id", ["n_chars"], ["text"], lambda x: x.where("n_chars > 1000")).select("doc_id", "text")


@query("SELECT count(*) AS n, count(*) AS n_places FROM lineitem")
def io_row_addresses(spark, d):
    a = S.with_address(table(spark, d, "lineitem").select("l_orderkey", "_metadata"))
    return a.agg(F.count("*").alias("n"), F.countDistinct("_file", "_row").alias("n_places"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(content, ' ')) AS token FROM knowledge_cards) WHERE token <> '' GROUP BY 1")
def token_counts(spark, d):
    return S.token_frequencies(table(spark, d, "knowledge_cards").select("content"), "content")


@query("SELECT 'first' AS part, true AS same, count(*) AS n FROM eval_items UNION ALL SELECT 'changed', false, count(*) FROM eval_items")
def io_freeze(spark, d):
    """A frozen sample of ids replayed with the same ids, and with one of them gone."""
    path = workspace(spark) + "/frozen"
    e = table(spark, d, "eval_items").select("eval_id")
    K.freeze(e, "eval_id", path)
    n = json.loads(K.read_text(spark, f"{path}/manifest.json"))["n_ids"]
    least = e.agg(F.min("eval_id").alias("eval_id"))
    out = [(p, K.replay(spark, x, "eval_id", path), n) for p, x in (("first", e), ("changed", e.join(least, "eval_id", "left_anti")))]
    return spark.createDataFrame(out, "part string, same boolean, n bigint")


@query("SELECT source, count(*) AS n FROM knowledge_cards WHERE source IS NOT NULL GROUP BY 1")
def io_versions(spark, d):
    """A version refused, superseded and read back, with the manifest naming what it replaced."""
    path = workspace(spark) + "/kb"
    cards = table(spark, d, "knowledge_cards").select("card_id", "source").where("source is not null")
    K.write_version(cards.limit(1), path, {"verdict": "CLEAN"})
    try:
        K.write_version(cards, path, {})
        raise AssertionError("an existing version was overwritten")
    except K.Exists:
        K.write_version(cards, path, {"verdict": "CLEAN"}, supersede="v1")
    if "supersedes" not in S.kb_manifest(spark, path):
        raise AssertionError("the manifest doesn't name the version before")
    return S.kb_values(spark, path).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT stem, dataset FROM (SELECT DISTINCT dataset || '_clip' AS stem, dataset FROM result_cells) WHERE dataset <> 'heysquad'")
def io_media(spark, d):
    """Rows whose media file exists, by a listing of the folder; one file is missing."""
    path = workspace(spark) + "/media"
    names = table(spark, d, "result_cells").select(F.concat("dataset", F.lit("_clip")).alias("stem"), "dataset").distinct()
    for r in names.where("dataset <> 'heysquad'").limit(1000).collect():  # a name per data set
        K.write_text(spark, f"{path}/{r.stem}.wav", "RIFF")
    return S.with_media(names, "stem", S.listing(spark, path)).select("stem", "dataset")


@query("SELECT count(*) AS n_values, count(*) AS n_covered FROM (SELECT DISTINCT kid, content FROM knowledge_cards WHERE kid IS NOT NULL AND trim(content) <> '')")
def children_cover(spark, d):
    """How many values their child parts, put together again, make up whole but for white space."""
    from quillon.plans.grid_queries import knowledge_values

    v = knowledge_values(spark, d)
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    c = J.child_rows(v).groupBy("parent_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.split_part("kid", F.lit("|"), F.lit(-1)).cast("int"), "value"))), lambda s: s["value"]), "").alias("whole"))  # two parts
    j = v.join(c, F.col("kid") == F.col("parent_ref"), "left")
    return j.agg(F.count("*").alias("n_values"), F.count_if(bare(F.col("value")) == bare(F.col("whole"))).alias("n_covered"))
