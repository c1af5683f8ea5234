import math
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import render, scoring
from quillon.functions import text as X
from quillon.operators import aggregates as G
from quillon.operators import audit as A
from quillon.operators import grid as J
from quillon.operators import retrieval as R
from quillon.operators import sampling as S
from quillon.operators import selectors as L
from quillon.operators import sets as U
from quillon.operators import stats as T
from quillon.sources import scans, sinks
from quillon.streaming import replay


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("reply,want", [("B.", 1), ("b) dog", 1), ("a dog", 0), ("the dog", 1), ("none", -1), ("", -1)])
def test_choice(spark, reply, want):
    assert one(spark, scoring.parse_choice(F.col("r"), F.col("o")), r=reply, o=["cat", "dog"]) == want


def test_choice_numbers(spark):
    assert one(spark, scoring.parse_choice(F.col("r"), F.col("o")), r="9. x", o=[f"v{i}" for i in range(10)]) == 9


def test_error_rates(spark):
    assert one(spark, scoring.char_error_rate(F.col("g"), F.col("r")), g="你好世界", r="你好世间") == 0.25
    assert one(spark, scoring.word_alignment(F.col("g"), F.col("r")), g="a b c", r="a x c d").asDict() == {"s": 1, "d": 0, "i": 1, "h": 2, "n": 3, "wer": 2 / 3}


def test_tool_call(spark):
    gold = F.create_map(F.lit("mode"), F.lit("On"))
    assert one(spark, scoring.tool_call(F.lit("setLight()"), gold, F.col("r")), r='ok {"name": "setLight", "arguments": {"mode": "on"}}') == 1
    assert one(spark, scoring.tool_call(F.lit("setLight()"), gold, F.col("r")), r="no call") == 0


def test_scrub(spark):
    assert one(spark, X.scrub(F.col("t"), F.col("g")), t="The BANANA split, banana!", g=["banana", "banana split", None, ""]) == "The , !"


def test_audit(spark):
    golds = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, g string")
    entries = spark.createDataFrame([(0, "the answer is banana0."), (1, "clean"), (2, None), (3, "")], "e long, t string")
    g = golds(["banana0", "kiwi"])
    found = A.containment(entries, "e", F.col("t"), g, "i", F.col("g"))
    assert [tuple(r) for r in found.collect()] == [(0, 0)]
    assert tuple(A.overlap_audit(found, g, "i").first()) == (2, 1, 0.5, "LEAKAGE")
    clean = A.scrubbed(entries, "t", g, "g")
    assert A.overlap_audit(A.containment(clean, "e", F.col("t"), g, "i", F.col("g")), g, "i").first()["verdict"] == "CLEAN"
    none = golds([])
    assert tuple(A.overlap_audit(A.containment(entries, "e", F.col("t"), none, "i", F.col("g")), none, "i").first()) == (0, 0, 0.0, "CLEAN")


def test_lock_finds_changes(spark):
    a = spark.createDataFrame([(1, "x  y"), (2, None)], "i long, t string").withColumn("s", F.lit("k"))
    b = spark.createDataFrame([(2, None), (1, "x y")], "i long, t string").withColumn("s", F.lit("k"))
    c = b.withColumn("t", F.lit("z"))
    lock = A.corpus_lock(a, ["s"], "i", "t")
    assert A.verify_lock(lock, A.corpus_lock(b, ["s"], "i", "t"), ["s"]).first()["verified"]
    assert A.verify_lock(lock, A.corpus_lock(c, ["s"], "i", "t"), ["s"]).first()["mismatches"] == "content_digest"


def test_holm(spark):
    df = spark.createDataFrame([(0.01, 1), (0.04, 2), (0.03, 3), (None, 4)], "p double, i int")
    assert [(r.i, r.p_holm, r.reject) for r in T.holm(df, "p", [], ["i"]).orderBy("i").collect()] == [(1, 0.03, True), (2, 0.06, False), (3, 0.06, False)]


def test_single_effect(spark):
    r = T.random_effects(spark.createDataFrame([("a", 0.5, 0.04)], "k0 string, y double, v double"), ["k0"], "y", "v").first()
    assert (r.q, r.tau2, r.i2) == (0, 0, 0) and math.isclose(r.lo, 0.5 - T.Z95 * 0.2) and r.k == 1


def test_bootstrap_sees_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{c}", i, float(e + rng.normal(0, 0.02))) for c, e in enumerate(rng.normal(0, 0.3, 10)) for i in range(12)]
    df = spark.createDataFrame([(g, f"{g}-{i}", s, 1) for g, i, s in rows], "g string, i string, s double, one int")
    by_cluster = T.cluster_bootstrap(df, ["one"], "s", "g", "i", nboot=2000).first()
    by_item = T.cluster_bootstrap(df.withColumn("g", F.lit(None).cast("string")), ["one"], "s", "g", "i", nboot=2000).first()
    assert by_cluster.hi - by_cluster.lo > 1.5 * (by_item.hi - by_item.lo)
    assert by_cluster.unit == "cluster" and by_item.unit == "item" and by_item.n_clusters == 120


def test_paired_bootstrap_finds_the_difference(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{c}", f"{c}-{i}", float(e + 0.15), float(e)) for c, e in enumerate(rng.normal(0, 0.2, 12)) for i in range(8)]
    df = spark.createDataFrame(rows, "g string, i string, a double, b double").withColumn("one", F.lit(1))
    r = T.paired_bootstrap(df, ["one"], "a", "b", "g", "i", nboot=1000).first()
    assert abs(r.delta - 0.15) < 0.05 and r.lo > 0 and r.p < 0.05


def test_macro_f1(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "a", None), (1, "b", "a"), (1, None, "a")], "k int, g string, p string")
    per, all_ = G.macro_f1(df, ["k"], "g", "p")
    assert {r.label: (r.precision, r.recall, r.f1, r.support) for r in per.collect()} == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 1)}
    assert all_.first().macro_f1 == 0.25


def test_group_draw_takes_whole_groups(spark):
    items = spark.createDataFrame([(f"i{n}", f"g{n // 4}") for n in range(12)], "id string, grp string")
    test = S.group_disjoint_draw(items, "id", F.col("grp"), 6, 2, 1).where("split = 'test'")
    assert test.count() == 8 and test.select("g").distinct().count() == 2
    assert S.disjoint_sizes(10, 60, 40) == (6, 4, 90)


def test_permutation_equals_numpy(spark):
    ids = [f"item{n:03d}" for n in range(50)]
    got = S.permutation_sample(spark.createDataFrame([(i,) for i in ids], "id string").repartition(7), "id", 10, 5).orderBy("pos").collect()
    assert [r.id for r in got] == [sorted(ids)[i] for i in np.random.default_rng(5).permutation(50)[:10]]


def test_first_of_and_nulls(spark):
    df = spark.createDataFrame([("k", None, 3), ("k", None, 0), ("k", "v", 1)], "k string, v string, i int")
    assert sorted(r.i for r in U.first_of(df, ["k", "v"], ["i"]).collect()) == [0, 1]


def test_edge_reorder(spark):
    df = spark.createDataFrame([(1, r) for r in range(5)], "q int, rank int")
    assert [r.rank for r in L.edge_reorder(df, "q", "rank").orderBy("position").collect()] == [0, 2, 4, 3, 1]


def test_rrf(spark):
    d = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, id string, rank int")
    s = spark.createDataFrame([(1, "y", 0), (1, "z", 1)], "query_id int, id string, rank int")
    got = [(r.id, r.score) for r in R.fuse(d, s, 5).orderBy("rank").collect()]
    assert [i for i, _ in got] == ["y", "x", "z"] and math.isclose(got[0][1], 1 / 62 + 1 / 61, abs_tol=1e-8)


def test_gate(spark):
    h = spark.createDataFrame([(1, 1.0, 0), (1, 0.95, 1), (1, 0.5, 2)], "query_id int, sim double, rank int")
    assert R.gate(h).count() == 2


def test_vector_top_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>").repartition(5)
    got = R.vector_top(df, "i", "v", df.where("i % 50 = 0"), "i", "v", 5, exclude_self=True).collect()
    for q in (0, 50, 100, 150):
        s = v @ v[q]
        s[q] = -np.inf
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-s)[:5].tolist()


def test_spans(spark):
    df = spark.createDataFrame(list(enumerate(["Other", "A", "A", "Other", "A"])), "i int, l string").withColumn("k", F.lit(1))
    assert sorted((r["first"], r["last"], r.l) for r in L.spans(df, ["k"], "i", "l", "Other").collect()) == [(1, 2, "A"), (4, 4, "A")]


def test_memory_batch_equals_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", f"{t:02d}", c, float(rng.normal()), 3, [f"w{rng.integers(9)}" for _ in range(3)]) for s in range(3) for t in range(6) for c in range(4)]
    schema = "spk string, step string, idx int, z double, n_tokens int, rare array<string>"
    df = spark.createDataFrame(rows, schema)
    for variant in ("set", "near", "count"):
        batch = {tuple(r) for r in L.memory_select(df, "spk", "step", variant).collect()}
        for half, keep in enumerate(("step < '03'", "step >= '03'")):
            df.where(keep).coalesce(1).write.parquet(f"{tmp_path}/{variant}/in/{half}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{variant}/in")
        q = replay.memory_stream(stream, "spk", "step", variant).writeStream.format("memory").queryName(f"out_{variant}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table(f"out_{variant}").collect()} == batch


def test_near_memory_compares_only_what_shares_a_token():
    rng = np.random.default_rng(3)
    m, past = L.Memory("near", 0.2), []
    for _ in range(60):
        pool = [frozenset(f"w{i}" for i in rng.integers(12, size=rng.integers(4))) for _ in range(4)]
        z = rng.normal(size=4).tolist()
        want = []
        for r, v in zip(pool, z):
            near = [x for x in sorted(((len(r & s) / len(r | s), u) for s, u in past if r | s), key=lambda x: -x[0])[:8] if x[0] > 0]
            want.append(0.8 * v + 0.2 * (sum(s * u for s, u in near) / sum(s for s, _ in near) if near else 0.0))
        assert m.score(pool, [3] * 4, z) == want
        m.update(pool, 0, z)
        past += zip(pool, z)
    assert m.size() == 240 and m.past() == [(set(s), u) for s, u in past]
    m, began = L.Memory("near", 0.2), time.process_time()
    for step in range(15_000):  # a pairwise comparison takes minutes
        pool = [frozenset([f"a{step}", f"b{step}"]), frozenset([f"a{step}", f"c{step}"])]
        m.score(pool, [2, 2], [1.0, -1.0])
        m.update(pool, 0, [1.0, -1.0])
    assert time.process_time() - began < 10


def test_count_memory_carries_its_sums():
    rng = np.random.default_rng(4)
    m, seen = L.Memory("count", 0.5), {}
    for _ in range(60):
        pool = [frozenset(f"w{i}" for i in rng.integers(30, size=rng.integers(4))) for _ in range(4)]
        z = rng.normal(size=4).tolist()
        size = sum(seen.values()) + max(1, len(set(seen).union(*pool)))
        a = np.array([sum(math.log((seen.get(w, 0) + 1) / size) for w in r) / len(r) if r else 0.0 for r in pool])
        zp = (a - a.mean()) / a.std() if a.std() > 0 else np.zeros(4)
        assert m.score(pool, [3] * 4, z) == [v + 0.5 * float(p) for v, p in zip(z, zp)]
        m.update(pool, 1, z)
        seen |= {t: seen.get(t, 0) + 1 for t in pool[1]}
        assert m.size() == sum(seen.values())
    m, began = L.Memory("count", 0.5), time.process_time()
    for step in range(30_000):  # a pass over all counts in each step takes minutes
        pool = [frozenset(f"{c}{step}" for c in "abcd"), frozenset([f"e{step}"])]
        m.score(pool, [4, 1], [1.0, -1.0])
        m.size()
        m.update(pool, 0, [1.0, -1.0])
    assert time.process_time() - began < 20


def test_batches_resume(spark, tmp_path):
    spark.range(20).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    work = lambda b: b.withColumn("v", F.col("id") * 2)
    for _ in range(2):
        replay.run_batches(stream(), work, f"{tmp_path}/out", f"{tmp_path}/check", "id")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    sinks.write_version(df, f"{tmp_path}/kb/src", {"n": 2})
    with pytest.raises(sinks.Exists):
        sinks.write_version(df, f"{tmp_path}/kb/src", {"n": 2})
    sinks.write_version(df.limit(1), f"{tmp_path}/kb/src", {"n": 1}, supersede="t1")
    assert spark.read.parquet(f"{tmp_path}/kb/src/values").count() == 1 and spark.read.parquet(f"{tmp_path}/kb/archive/src__superseded_t1/values").count() == 2
    sinks.freeze(df, "id", f"{tmp_path}/snap")
    assert sinks.replay(spark, df, "id", f"{tmp_path}/snap") and not sinks.replay(spark, df.union(df), "id", f"{tmp_path}/snap")
    assert "| a |" in sinks.markdown(df)


def test_scans(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/x.zip", "w") as z:
        z.writestr("d/a.jsonl", '{"q": 1}\n{"q": 2}\n')
        z.writestr("b.txt", "no")
    assert [r.line for r in scans.zip_members(spark, f"{tmp_path}/x.zip").orderBy("line_no").collect()] == ['{"q": 1}', '{"q": 2}']
    (tmp_path / "t.tsv").write_text("a\tb\tc\nonly\ttwo\n")
    assert scans.tab_rows(spark, str(tmp_path / "t.tsv"), ["x", "y", "z"]).count() == 1
    (tmp_path / "cells").mkdir()
    (tmp_path / "cells" / "ok.json").write_text('{"dataset": "d", "backbone": "b", "split": "s", "per_item": [{"item_id": "1", "score": 1}, {"item_id": "2"}]}')
    (tmp_path / "cells" / "bad.json").write_text('{"dataset": ')
    (tmp_path / "cells" / "part.json").write_text('{"dataset": "d"}')
    cells, warnings = scans.result_cells(spark, str(tmp_path / "cells"))
    assert scans.exploded_items(cells).count() == 2 and sorted(r.reason for r in warnings.collect()) == ["incomplete", "unreadable"]
    np.savez(f"{tmp_path}/e.npz", doc_ids=np.array(["a", "b"]), vectors=np.zeros((2, 3), dtype="float32"))
    assert scans.embeddings_npz(spark, f"{tmp_path}/e.npz").count() == 2
    (tmp_path / "m.json").write_text('[["a", "g"], ["a", "h"]]')
    with pytest.raises(ValueError):
        scans.group_manifest(spark, str(tmp_path / "m.json"))
    spark.createDataFrame([(1, "x", None), (2, "y", "z")], "n int, q string, a string").write.parquet(f"{tmp_path}/ds")
    load = scans.loader(f"{tmp_path}/ds", "parquet", None, "n", "a", "'dev'", keep="a is not null", meta={"q": "q"}, sort="n")
    assert [tuple(r) for r in load(spark).collect()] == [("2", '{"gold":"z"}', "dev", {"q": "y"})]


def test_grid_guards(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(ValueError):
        J.require_disjoint(a, b, ["k"])
    with pytest.raises(ValueError):
        J.require_complete(b, a, "k")


def test_cards(spark):
    assert one(spark, render.band(F.col("s").cast("double")), s="0.85") == "high"
    assert one(spark, render.option_block(F.col("o")), o=["x", "y"]) == "A. x\nB. y"


@pytest.mark.parametrize("value,n", [("One. Two! Three?\n\nFour. Five.", 2), ("One. Two. Three.", 2), ("One. Two.", 2), ("Only one", 1), ("一。二。 三！ 四", 2)])
def test_child_rows_cover_the_value(spark, value, n):
    got = J.child_rows(spark.createDataFrame([("k", "s", value)], "kid string, source string, value string")).orderBy("kid").collect()
    assert [r.kid for r in got] == [f"k|{i}" for i in range(n)]
    at = 0
    for r in got:  # nothing but white space lies between the parts
        assert not value[at : value.index(r.value, at)].strip()
        at = value.index(r.value, at) + len(r.value)
    assert at == len(value)


def test_clustered_search_finds_all_neighbours(spark, tmp_path):
    from quillon import queries as core

    x = np.random.default_rng(2).normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    v = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    want = R.vector_top(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    got = core.queries()["vec_clustered_two_stage"](spark, str(tmp_path))
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    assert len(pairs(want)) == 40 and pairs(got) == pairs(want)  # recall 1


def test_bound_leaves_out_only_far_clusters(spark):
    x = np.random.default_rng(3).normal(size=(120, 6)) * 0.02 + np.repeat(np.eye(6)[:4], 30, axis=0)
    df = spark.createDataFrame([(i, v.tolist(), i // 30) for i, v in enumerate(x)], "i long, v array<double>, l int")
    rows = lambda r: {(x.query_id, x.vec_id, x.rank) for x in r.collect()}
    q = df.where("i % 10 = 0")
    assert rows(R.two_stage(df, "i", "v", "l", q, "i", "v", 7, coarse=None)) == rows(R.vector_top(df, "i", "v", q, "i", "v", 7))


@pytest.mark.parametrize("name,operator,n", [
    ("cluster_intervals", "cluster_bootstrap", 10_000), ("interval_variances", "cluster_bootstrap", 10_000), ("paired_intervals", "paired_bootstrap", 10_000),
    ("max_t_adjusted", "max_t", 10_000), ("nested_interval", "nested_bootstrap", 2_000), ("index_intervals", "index_bootstrap", 2_000),
])
def test_bootstraps_draw_all_replicates(spark, data, monkeypatch, name, operator, n):
    import inspect

    from quillon import queries as core

    real, seen = getattr(T, operator), []

    def record(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments["nboot"])
        return real(*args, **kwargs)

    monkeypatch.setattr(T, operator, record)
    core.queries()[name](spark, data)
    assert seen == [n]
