"""Lexical, vector and fused retrieval. Query sets are stated and bounded; the searched side is scanned where it lies."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import tokens
from quillon.plans.runtime import bounded_rows, broadcast_if_small, cut

#: Queries multiplied at a time with a batch of vectors in a worker.
QUERY_BLOCK = 1024
#: Bound of a stated query set.
MAX_QUERIES = 1_000_000


def top_k(df: DataFrame, query: str, score: str, tie: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The k rows of every query with the highest score, ties by the tie columns; rank from 0.

    The limit on row_number is pushed below the shuffle as a group limit, so k rows a query and task are shuffled.
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), *tie)
    return df.withColumn(rank, (F.row_number().over(w) - 1).cast("int")).where(F.col(rank) < k)


# -- lexical ---------------------------------------------------------------------------------------------------------


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with a query, by Okapi BM25.

    Terms are lower-case tokens between white space; a term repeated in a query counts as often; null texts are empty.
    The documents are tokenized once, in a pass that counts the occurrences of query terms and gives each document a row
    without a term for the totals. The query side goes to the postings where it is small by its written size, so a
    frequent term is no hot key, and a document's scores are summed before the shuffle.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("term"))
    q = cut(q.groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    terms = broadcast_if_small(q.select("term").distinct().withColumn("wanted", F.lit(True)))
    one = d.select("doc_id", F.size("t").alias("dl"), F.explode_outer(F.concat("t", F.array(F.lit(None).cast("string")))).alias("term"))
    tf = cut(one.join(terms, "term", "left").where("wanted or term is null").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("f")))
    stats = tf.where("term is null").agg(F.sum("f").alias("n_docs"), (F.sum(F.col("dl") * F.col("f")) / F.sum("f")).alias("avgdl"))
    df = tf.where("term is not null").groupBy("term").agg(F.sum(F.lit(1)).alias("df"))
    weight = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = cut(q.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "qtf", weight.alias("idf"), "avgdl"))  # stats: one row
    dl = F.greatest(F.col("dl"), F.lit(1))
    part = F.col("idf") * (F.col("f") * (k1 + 1)) / (F.col("f") + k1 * (1 - b + b * dl / F.col("avgdl"))) * F.col("qtf")
    scored = tf.where("term is not null").join(broadcast_if_small(weighted), "term")
    return scored.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25_top(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): scores are compared to nine places, ties by doc_id."""
    s = bm25(docs, doc_id, text, queries, query_id, query_text).withColumn("score", F.round("score", 9))
    return top_k(s, "query_id", "score", ["doc_id"], k)


def tf_idf(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, weight): smooth idf ln((1+n)/(1+df))+1 times counts, each document of length one."""
    occ = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("f"))
    df = occ.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = occ.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("f") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, "doc_id").select("doc_id", "term", (F.col("w") / F.col("len")).alias("weight"))


# -- vectors ---------------------------------------------------------------------------------------------------------


def vector_top(vectors: DataFrame, vec_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int, exclude_self: bool = False, min_sim: float | None = None) -> DataFrame:
    """(query_id, vec_id, sim, rank): exact inner products of a stated query set against all vectors, the best k each.

    Queries are sent out as a matrix; every task multiplies its batches with it, a block of queries at a time, and keeps k
    rows a query, so the vectors are scanned once and k rows a query and batch are shuffled rather than all pairs.
    Similarities are in double precision, compared to nine places, ties by vec_id. Null query vectors are left out; null
    vectors, and vectors of another dimension than the queries', raise.
    """
    rows = bounded_rows(queries.select(F.col(query_id).alias("i"), F.col(query_vec).alias("v")).where("v is not null"), MAX_QUERIES, "vector queries")
    type_q, type_v = queries.schema[query_id].dataType.simpleString(), vectors.schema[vec_id].dataType.simpleString()
    matrix = np.array([r["v"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(([r["i"] for r in rows], matrix))

    def run(batches):
        import pyarrow as pa

        ids, m = shared.value
        for b in batches:
            keys = b.column(0).to_pylist()
            if not keys or not ids:
                continue
            v = np.array(b.column(1).to_pylist(), dtype=np.float64)
            if v.shape[1] != m.shape[1]:
                raise ValueError(f"vectors of {v.shape[1]} and {m.shape[1]} dimensions")
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
            keys, v = [keys[i] for i in order], v[order]
            own: dict = {}
            for j, x in enumerate(keys):
                own.setdefault(x, []).append(j)
            n = len(keys)
            take = min(k, n)
            for at in range(0, len(ids), QUERY_BLOCK):
                part = ids[at : at + QUERY_BLOCK]
                sims = np.round(m[at : at + QUERY_BLOCK] @ v.T, 9)
                if exclude_self:
                    for i, q in enumerate(part):
                        sims[i, own.get(q, [])] = -np.inf
                good = sims >= np.partition(sims, n - take, axis=1)[:, n - take, None]
                good &= sims > -np.inf if min_sim is None else sims >= min_sim
                for i in np.flatnonzero(good.sum(1) > take):  # ties at the last place: the lowest ids
                    j = np.flatnonzero(good[i])
                    good[i] = False
                    good[i, j[np.argsort(-sims[i, j], kind="stable")[:take]]] = True
                qi, vi = np.nonzero(good)
                qs, vs = [part[i] for i in qi], [keys[j] for j in vi]
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()) if type_q == "bigint" else pa.array(qs), pa.array(vs, b.column(0).type), pa.array(sims[qi, vi], pa.float64())], names=["query_id", "vec_id", "sim"])

    found = vectors.select(vec_id, vec).mapInArrow(run, f"query_id {type_q}, vec_id {type_v}, sim double")
    return top_k(found, "query_id", "sim", ["vec_id"], k)


def gate(hits: DataFrame, frac: float = 0.9) -> DataFrame:
    """Hits with at least frac of their query's best similarity; the best one in any case."""
    top = F.max("sim").over(Window.partitionBy("query_id"))
    return hits.withColumn("_t", top).where((F.col("sim") >= frac * F.col("_t")) | (F.col("rank") == 0)).drop("_t")


def exclude_own(hits: DataFrame, from_item: str, item: str) -> DataFrame:
    """Hits that don't come from the query's own item; a null on either side keeps the hit."""
    return hits.where(F.col(item).isNull() | F.col(from_item).isNull() | (F.col(from_item) != F.col(item)))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, c: int = 60) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of two rankings (query_id, id, rank)."""
    d, s = dense.select("query_id", "id", F.col("rank").alias("rd")), sparse.select("query_id", "id", F.col("rank").alias("rs"))
    part = lambda r: F.coalesce(1.0 / (c + F.col(r) + 1), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full").select("query_id", "id", F.round(part("rd") + part("rs"), 9).alias("score"))
    return top_k(both, "query_id", "score", ["id"], k)


def centroids(vectors: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, centroid): normalized mean vectors, summed per position on the executors."""
    pos = vectors.where(F.col(vec).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vec).alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = pos.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c"))  # a value per dimension
    size = F.greatest(F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
    return one.select("label", F.transform("c", lambda x: x / size).alias("centroid"))


def two_stage(vectors: DataFrame, vec_id: str, vec: str, label: str, queries: DataFrame, query_id: str, query_vec: str, k: int, coarse: int | None = 2) -> DataFrame:
    """(query_id, vec_id, sim, rank): exact ranking within the coarse clusters whose centroids are nearest.

    With coarse None nothing is lost: every cluster is searched but those that can't hold one of the best k, as the
    query's product with the centroid and the radius around it bound the members' similarity below the k-th one found.
    label is any clustering of the vectors, such as assign_clusters gives. Queries meet the centroids only, then the
    members of their clusters by an equi-join on the cluster.
    """
    from quillon.functions.text import dot

    c = centroids(vectors, vec, label)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv"))
    near = q.crossJoin(broadcast_if_small(c)).select("query_id", "qv", "label", F.round(dot(F.col("qv"), F.col("centroid")), 9).alias("csim"))
    if coarse is None:
        gap = F.sqrt(F.aggregate(F.zip_with(vec, "centroid", lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x * x))
        radius = vectors.select(vec, F.col(label).alias("label")).join(c, "label").groupBy("label").agg(F.max(gap).alias("radius"))
        found = two_stage(vectors, vec_id, vec, label, queries, query_id, query_vec, k)
        kth = found.where(F.col("rank") == k - 1).select("query_id", F.col("sim").alias("kth"))
        most = F.col("csim") + F.sqrt(dot(F.col("qv"), F.col("qv"))) * F.col("radius") + 1e-8
        near = near.join(radius, "label").join(kth, "query_id", "left").where(F.col("kth").isNull() | (most >= F.col("kth"))).select("query_id", "qv", "label")
    else:
        near = top_k(near, "query_id", "csim", ["label"], coarse, "crank")
    members = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("v"), F.col(label).alias("label"))
    sims = near.join(members, "label").select("query_id", "vec_id", F.round(dot(F.col("qv"), F.col("v")), 9).alias("sim"))
    return top_k(sims, "query_id", "sim", ["vec_id"], k)


def assign_clusters(vectors: DataFrame, vec_id: str, vec: str, k: int, sample: int = 20_000, rounds: int = 25, seed: int = 0) -> DataFrame:
    """(vec_id, vec, cluster): k-means fitted on at most about sample vectors, every vector assigned to the nearest centroid."""
    n = vectors.count()
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(vec_id)), F.lit(1 << 20))
    rows = bounded_rows(vectors.where(unit < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1)).orderBy(vec_id).select(vec), 4 * sample + 1000, "vectors to fit on")
    x = np.array([r[0] for r in rows], dtype=np.float64)
    k = max(1, min(k, len(x)))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, 1))
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    @F.pandas_udf("int")
    def nearest(v):
        import pandas as pd

        m = shared.value
        y = np.array(v.tolist(), dtype=np.float64)
        return pd.Series(np.argmax(y @ m.T - 0.5 * (m * m).sum(1), axis=1).astype("int32"))

    return vectors.select(vec_id, vec, nearest(F.col(vec)).alias("cluster"))


def two_hop(first: DataFrame, docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the best hit's text is appended to the query, which is searched again; a document
    found twice keeps its first hit."""
    best = first.where("rank = 0").select("query_id", F.col("doc_id").alias("_d"))
    more = best.join(docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")), "_d")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("_q")).join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "_q", "_t").alias("q2"))
    second = bm25_top(docs, doc_id, text, q, "query_id", "q2", k)
    hops = first.select("query_id", "doc_id", "score", F.lit(1).alias("hop"), "rank").union(second.select("query_id", "doc_id", "score", F.lit(2), "rank"))
    kept = hops.groupBy("query_id", "doc_id").agg(F.min(F.struct("hop", "rank", "score")).alias("h")).select("query_id", "doc_id", F.col("h.score").alias("score"))
    return top_k(kept, "query_id", "score", ["doc_id"], k)


def pool_size(kind: Column, k: int) -> Column:
    """Candidates to fetch for a kind of retrieval."""
    return F.when(kind == "long-context-stuffing", 50).when(kind.isin("retrieve-then-select", "two-stage"), max(4 * k, 10)).otherwise(k)


def ndcg(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, recall, ndcg) at k against gold (query_id, id), one gain a gold; queries without gold are left out."""
    g = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") < k).join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 2)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(math.log(2)) / F.log(i + 1.0))
    return g.join(found, "query_id", "left").select("query_id", F.coalesce((F.col("h") > 0).cast("int"), F.lit(0)).alias("hit"), F.coalesce(F.col("h") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


# -- control arms and dispatch ---------------------------------------------------------------------------------------


def query_text(kind: Column, question: Column, transcript: Column, hypothetical: Column, instruction: str = "Find passages that answer: ") -> Column:
    """The text a query is asked with: a transcript, a transcript behind an instruction, or a passage written for it (null
    for queries asked as audio, whose vector comes from outside)."""
    return F.when(kind == "text", question).when(kind == "transcript", transcript).when(kind == "asymmetric", F.concat(F.lit(instruction), transcript)).when(kind == "hypothetical", hypothetical)


def random_hits(queries: DataFrame, query_id: str, pool: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """(query_id, id, rank): k entries for every query, drawn from the pool without regard to similarity.

    The pool is put into the draw order of its ids; a query takes k neighbours from a place given by its hash, so that
    queries and pool meet by an equi-join on the place. The places are numbered per range partition.
    """
    ids = cut(pool.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)))
    bucket = F.conv(F.substring("_k", 1, 4), 16, 10).cast("int")
    sizes = ids.groupBy(bucket.alias("_b")).agg(F.count("*").alias("n"))
    base = sizes.select("_b", (F.sum("n").over(Window.orderBy("_b")) - F.col("n")).alias("base"))  # at most 65,536 rows
    placed = ids.withColumn("_b", bucket).join(base, "_b").select("id", (F.col("base") + F.row_number().over(Window.partitionBy("_b").orderBy("_k", "id")) - 1).alias("place"))
    n = ids.agg(F.count("*").alias("n"))
    start = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:query:"), F.col(query_id).cast("string")), 256), 1, 13), 16, 10).cast("bigint")
    want = queries.select(F.col(query_id).alias("query_id"), start.alias("s")).crossJoin(F.broadcast(n)).where("n > 0")  # one row
    want = want.select("query_id", "s", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n").cast("int")) - 1)).alias("rank"))
    return want.withColumn("place", F.pmod(F.col("s") + F.col("rank"), F.col("n"))).join(placed, "place").select("query_id", "id", "rank")


def oracle_hits(gold: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): the first k judged entries of every query, from gold (query_id, id)."""
    w = Window.partitionBy("query_id").orderBy("id")
    return gold.select("query_id", "id").distinct().withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)


def control_arms(queries: DataFrame, query_id: str, pool: DataFrame, id_col: str, gold: DataFrame, own: DataFrame, k: int, seed: int) -> DataFrame:
    """(arm, query_id, id, rank) of the control arms: random entries, judged entries, and the query's own (query_id, id),
    which alone may come from the query's item. The arm without retrieval has no rows."""
    mine = own.select("query_id", "id").withColumn("_own", F.lit(True))
    others = lambda h: h.join(mine, ["query_id", "id"], "left_anti")
    arms = {"random": others(random_hits(queries, query_id, pool, id_col, k, seed)), "oracle": others(oracle_hits(gold, k)), "own": oracle_hits(own, k)}
    return reduce(DataFrame.union, (h.select(F.lit(a).alias("arm"), "query_id", "id", "rank") for a, h in arms.items()))


def projected(hits: DataFrame, values: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Hits with the fields of the entries found; an entry that is gone leaves its hit out."""
    return hits.join(values.select(F.col(id_col).alias("id"), *fields), "id")


def retrieve(kind: str, k: int, dense: Callable[[int], DataFrame] | None = None, sparse: Callable[[int], DataFrame] | None = None, two_hop_: Callable[[int], DataFrame] | None = None, threshold: float = 0.3) -> DataFrame:
    """(query_id, id, rank, ...): one kind of retrieval over given searches, each a function of the number of hits."""
    if kind == "dense-topk":
        return dense(k)
    if kind == "fixed-threshold":
        return dense(k).where(F.col("sim") >= threshold)
    if kind == "retrieve-then-select":
        return gate(dense(max(4 * k, 10))).where(F.col("rank") < k)
    if kind == "long-context-stuffing":
        return dense(50)
    if kind == "hybrid-bm25-dense-rrf":
        return fuse(dense(2 * k), sparse(2 * k), k)
    if kind == "sparse-topk":
        return sparse(k)
    if kind == "ircot-2hop":
        return two_hop_(k)
    raise ValueError(f"unknown kind of retrieval: {kind}")
