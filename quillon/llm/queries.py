"""The pN_ queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chunking, defects, encode, leakage, lookalike, mixing, sampling, splits, truncation
from quillon.plans.runtime import table

ITEM = ["dataset", "item_id"]


def items_with_gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "result_items").withColumn("gold", F.col("detail.gold"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(items_with_gold(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(items_with_gold(spark, d), ["dataset", "backbone"])


def p2_leaks(spark: SparkSession, d: str, max_edits: int = 0) -> DataFrame:
    held = table(spark, d, "eval_items").withColumn("gold", F.col("detail.gold"))
    return leakage.union_holders({
        "documents": leakage.find_leaks(table(spark, d, "documents"), held, "doc_id", "text", max_edits=max_edits),
        "knowledge_cards": leakage.find_leaks(table(spark, d, "knowledge_cards"), held, "card_id", "content", max_edits=max_edits),
    })


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_leaks(spark, d).select("holder", "holder_id", "eval_id")


def p2_near(spark: SparkSession, d: str) -> DataFrame:
    """Also windows that differ by up to two edits."""
    return p2_leaks(spark, d, max_edits=2)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p2_found(spark, d), table(spark, d, "eval_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_pairs(table(spark, d, "result_items"), ITEM, "group_id")


def p3_forest(spark: SparkSession, d: str) -> DataFrame:
    return splits.spanning_forest(splits.ties(table(spark, d, "result_items"), ITEM, "group_id"))


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return splits.units(table(spark, d, "result_items"), ITEM, "group_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many items, groups and tied units lie in more than one split."""
    s = p3_splits(spark, d)
    g = table(spark, d, "result_items").where("group_id is not null").select(*ITEM, "group_id").distinct().join(s, ITEM)
    torn = lambda df, by: df.groupBy(*by).agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"), F.count("*").alias("n"))
    parts = [torn(s, ITEM).withColumn("what", F.lit("items")), torn(g, ["group_id"]).withColumn("what", F.lit("groups"))]
    return parts[0].union(parts[1]).select("what", "n", "torn")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "result_items"), ITEM, "group_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    s = p3_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_items"), F.countDistinct("root").alias("n_units"))
    every = s.agg(F.sum("n_items").alias("n"))
    return s.crossJoin(F.broadcast(every)).select("split", "n_items", "n_units", (F.col("n_items") / F.col("n")).alias("share"))  # one row


RATE = 0.1


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_items(table(spark, d, "result_items"), ITEM, RATE)


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stable_sample(table(spark, d, "result_items"), ITEM, RATE).select("row_id", *ITEM)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(items_with_gold(spark, d), ITEM, ["reply", "gold"], "row_id", ["reply", "gold", "instr"])


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_classes(items_with_gold(spark, d), ITEM, ["reply", "gold"], "row_id", ["reply", "gold", "instr"])


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify_texts(items_with_gold(spark, d), ["row_id"], ["reply", "gold"], ["reply", "gold", "instr"]).select("row_id", "field", "fixed", "n_repairs")


def answered(spark: SparkSession, d: str) -> DataFrame:
    return items_with_gold(spark, d).where("error is null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(answered(spark, d), table(spark, d, "documents"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_report(p6_found(spark, d), answered(spark, d), ["dataset", "backbone"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = encode.decode_ids(p8_ids(spark, d)).withColumnRenamed("doc_id", "id")
    return docs.join(back, F.col("doc_id") == F.col("id")).groupBy((F.col("was") == F.col("text")).alias("equal")).agg(F.count("*").alias("n"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_marginals(p9_mix(spark, d))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_limits(p9_mix(spark, d), table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, d, "documents"), limit=256, overlap=32)


def p10_cover(spark: SparkSession, d: str) -> DataFrame:
    """How many texts their pieces cover without gap or change, and how many pieces of a text over the limit reach it
    (a text of just the limit is left whole)."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("text <> ''")
    pieces = chunking.chunk_texts(table(spark, d, "documents"), limit=256, overlap=32, keep_small=True)
    same = F.col("piece") == F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    j = docs.join(pieces, "doc_id").groupBy("doc_id").agg(
        F.min(same.cast("int")).alias("same"), F.sum(F.col("end_char") - F.col("core_start")).alias("covered"), F.min(F.length("text")).alias("n"), F.count_if((F.col("n_tokens") > 256) | ((F.col("n_pieces") > 1) & (F.col("n_tokens") >= 256))).alias("over")
    )
    return j.agg(F.count("*").alias("n_texts"), F.count_if((F.col("same") == 1) & (F.col("covered") == F.col("n"))).alias("n_covered"), F.coalesce(F.sum("over"), F.lit(0)).alias("n_over"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_near, p2_report, p3_found, p3_forest, p3_units, p3_splits, p3_kept, p3_report, p4_sample, p4_rows, p5_found, p5_classes, p5_unified, p6_found, p6_report, p8_ids, p8_round_trip, p9_mix, p9_report, p9_marginals, p9_limits, p10_pieces, p10_cover)}


def oracle_sql() -> dict[str, str]:
    unit = "(('0x' || substr(md5('sample-1|' || length(dataset) || ':' || dataset || '|' || length(item_id) || ':' || item_id), 1, 13))::BIGINT / 4503599627370496.0)"
    return {
        "p3_found": """
            WITH RECURSIVE m AS (SELECT DISTINCT dataset, item_id, group_id AS g FROM result_items WHERE group_id IS NOT NULL),
            e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM m x JOIN m y USING (dataset, item_id) WHERE x.g <> y.g),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
            SELECT DISTINCT a AS group_a, b AS group_b FROM r WHERE a < b""",
        "p3_units": """
            WITH RECURSIVE m AS (SELECT DISTINCT dataset, item_id, group_id AS g FROM result_items WHERE group_id IS NOT NULL),
            e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM m x JOIN m y USING (dataset, item_id) WHERE x.g <> y.g),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
            SELECT a AS group_id, min(b) AS root, count(*) AS n_groups FROM (SELECT a, b FROM r UNION SELECT a, a FROM e) GROUP BY a""",
        "p3_kept": """
            SELECT 'items' AS what, count(*) AS n, 0::BIGINT AS torn FROM (SELECT DISTINCT dataset, item_id FROM result_items WHERE dataset IS NOT NULL AND item_id IS NOT NULL)
            UNION ALL SELECT 'groups', count(DISTINCT group_id), 0 FROM result_items WHERE dataset IS NOT NULL AND item_id IS NOT NULL""",
        "p4_sample": f"""
            SELECT dataset, item_id, count(*) AS n_rows, {unit} AS u FROM result_items
            WHERE dataset IS NOT NULL AND item_id IS NOT NULL AND {unit} < 0.1 GROUP BY dataset, item_id""",
        "p4_rows": f"SELECT row_id, dataset, item_id FROM result_items WHERE {unit} < 0.1",
        "p9_limits": """
            SELECT t.source, count(d.doc_id) AS n_texts, 0::BIGINT AS n_above_cap FROM mix_targets t
            LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY t.source""",
        "p10_cover": "SELECT count(*) AS n_texts, count(*) AS n_covered, 0::BIGINT AS n_over FROM documents WHERE text <> ''",
        "p8_round_trip": "SELECT true AS equal, count(*) AS n FROM documents",
    }
