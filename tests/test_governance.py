import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillon.functions import scoring as C
from quillon.functions.text import class_by_prefix, plural_match
from quillon.operators import governance as V
from quillon.operators import retrieval as R
from quillon.operators import selectors as L
from quillon.operators import stats as T
from quillon.sources import scans as S
from quillon.sources import sinks as K

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_only_clean_sources_are_loaded(spark, tmp_path):
    v = spark.createDataFrame([(1, "a")], "id long, value string")
    path = f"file://{tmp_path}/kb"
    with pytest.raises(V.Refused):
        V.persist_source(v, f"{path}/leak", "LEAKAGE")
    assert V.persist_source(v, f"{path}/leak", "LEAKAGE", force=True)["forced"]
    assert not V.persist_source(v, f"{path}/open", "LEAKAGE", enforce=False)["forced"]
    V.persist_source(v, f"{path}/none", None), V.persist_source(v, f"{path}/clean", "CLEAN")
    for name in ("leak", "open", "none"):
        with pytest.raises(V.Refused):
            V.load_source(spark, f"{path}/{name}")
        assert V.load_source(spark, f"{path}/{name}", allow_unclean=True)[0].count() == 1
    values, manifest = V.load_source(spark, f"{path}/clean")
    assert values.count() == 1 and manifest["verdict"] == "CLEAN"
    assert {(r.source, r.verdict, r.forced) for r in S.kb_sources(spark, path).collect()} == {("leak", "LEAKAGE", True), ("open", "LEAKAGE", False), ("none", None, False), ("clean", "CLEAN", False)}


def test_routes(spark):
    rows = [("text", "glap"), ("audio", "glap"), ("audio", "clap"), ("audio", None)]
    df = spark.createDataFrame(rows, "m string, e string").withColumn("route", V.routed(F.col("m"), F.lit("text"), F.coalesce("e", F.lit(""))))
    assert [r.route for r in df.collect()] == ["same", "refused: pending", "cross", "refused: unknown"]
    with pytest.raises(Exception, match="refused"):
        V.require_routed(df, "route").collect()
    assert V.require_routed(df.where("m = 'text'"), "route").count() == 1


def test_config():
    V.check_config({"kind": "a", "k": 3}, {"kind": ("a", "b"), "k": ()})
    with pytest.raises(ValueError, match="gold is forbidden; kind=.* isn't one of .*; x is unknown"):
        V.check_config({"kind": "c", "gold": 1, "x": 2}, {"kind": ("a", "b")}, ("gold",))


def test_audit_of_sources(spark):
    v = spark.createDataFrame([(1, "s", "the answer is kiwi"), (2, "t", "nothing"), (3, "u", None)], "id long, source string, text string")
    g = spark.createDataFrame([(1, "kiwi"), (2, "plum")], "g_id long, gold string")
    got = {r.source: (r.n_leaked, r.verdict) for r in V.audited(v, "id", F.col("text"), g, "g_id", F.col("gold")).collect()}
    assert got == {"s": (1, "LEAKAGE"), "t": (0, "CLEAN"), "u": (0, "CLEAN")}
    assert {r.verdict for r in V.audited(v, "id", F.col("text"), g.limit(0), "g_id", F.col("gold")).collect()} == {"CLEAN"}


@pytest.mark.parametrize("reply,want", [("B.", 1), ("b) dog", 1), ("a dog", 0), ("the dog", 1), ("none", -1), ("", -1), (None, None), ("i dog", 1)])
def test_choices(spark, reply, want):
    assert one(spark, C.parse_choice(F.col("t"), F.col("o")), t=reply, o=["cat", "dog"]) == want


def test_labels_intents_and_options(spark):
    o = ["set alarm", "play music", "stop"]
    assert one(spark, C.intent_match(F.lit("play music"), F.col("t"), F.col("o")), t=" 1: it", o=o) == 1
    assert one(spark, C.intent_match(F.lit("play music"), F.col("t"), F.col("o")), t="Play, music!", o=o) == 1
    assert one(spark, C.intent_match(F.lit("play music"), F.col("t"), F.col("o")), t="2", o=o) == 0
    assert one(spark, C.intent_match(F.col("g"), F.lit("x"), F.col("o")), g=None, o=o) == 0
    for gold, want in (("play music", 1), ("B", 1), ("b.", 1), ("B、play", 1), ("C", 0), ("unknown", 0), (None, 0)):
        assert one(spark, C.choice_match(F.col("g"), F.lit("B"), F.col("o")), g=gold, o=o) == want
    assert tuple(one(spark, C.closed_choice(F.lit("Stop"), F.col("t"), F.col("o")), t="please stop now", o=o)) == (1, "stop")
    assert tuple(one(spark, C.closed_choice(F.lit("Stop"), F.col("t"), F.col("o")), t=None, o=o)) == (0, None)
    assert [one(spark, C.label_of(F.col("t"), F.col("o")), t=t, o=o) for t in ("do stop and set alarm", "some music", "nothing")] == ["set alarm", "play music", None]


def test_words(spark):
    assert [one(spark, plural_match(F.col("w"), F.lit(x)), w=["DOGS", "CAT"]) for x in ("DOG", "DOGS", "CATS", "COW")] == [True, True, True, False]
    assert [one(spark, class_by_prefix(F.col("t"), {"a": "one", "ab": "two"}, "none"), t=t) for t in ("abc", "ac", "x", None)] == ["two", "one", "none", "none"]


def test_random_hits_are_drawn_without_repeats(spark):
    q, pool = spark.range(30).withColumnRenamed("id", "q"), spark.range(50)
    h = R.random_hits(q, "q", pool, "id", 5, 1)
    assert h.count() == 150 and h.groupBy("query_id").agg(F.countDistinct("id").alias("n")).where("n < 5").count() == 0
    assert h.select("id").distinct().count() > 40
    assert sorted(map(tuple, R.random_hits(q, "q", pool.repartition(7), "id", 5, 1).collect())) == sorted(map(tuple, h.collect()))
    assert R.random_hits(q, "q", pool.limit(3), "id", 5, 1).count() == 90 and R.random_hits(q, "q", pool.limit(0), "id", 5, 1).count() == 0


def test_own_entries_are_left_to_the_own_arm(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "query_id long, id long")
    own = gold.where("id <> 11")
    got = {tuple(r) for r in R.control_arms(gold.select("query_id").distinct(), "query_id", gold, "id", gold, own, 3, 1).select("arm", "query_id", "id").collect()}
    assert ("oracle", 1, 11) in got and ("own", 1, 10) in got and ("own", 2, 12) in got
    assert not {(a, q, i) for a, q, i in got if a != "own" and (q, i) in {(1, 10), (2, 12)}}


def test_selectors(spark):
    df = spark.createDataFrame([("p", 0, 1.0, 0, 4), ("p", 1, 0.5, 2, 3), ("p", 2, 0.4, 2, 9), ("q", 0, 1.0, 1, 1), ("q", 1, 2.0, 1, 1)], "pool string, idx int, z double, o int, n int")
    assert {tuple(r) for r in L.overlap_flip(df, ["pool"], "o", "z").collect()} == {("p", 0, 1, True), ("q", 1, 1, False)}
    assert {tuple(r) for r in L.flip_weights(df, ["pool"], "o", "z", "n").collect()} == {("p", 1.5)}
    assert {tuple(r) for r in L.battery(df, ["pool"], {"z": "z"}, (1, 2)).collect()} == {("p", 1, "z", 0), ("p", 2, "z", 0), ("q", 1, "z", 0), ("q", 2, "z", 1)}
    t = spark.createDataFrame([("e", i, w, "B") for i, w in enumerate(["A", "B", "A", "B", "C"])] + [("f", 9, "X", "Y")], "k string, i int, w string, truth string")
    assert {tuple(r) for r in L.truth_rank(t, ["k"], "w", "i", "truth").collect()} == {("e", 2, False, True), ("f", None, False, False)}
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "a"), (1, 3, "b"), (1, 4, "c")], "u long, o long, v string")
    assert sorted((r.o, r.n_past) for r in L.past_distinct(e, "u", "o", "v").collect()) == [(1, 0), (2, 1), (3, 1), (3, 1), (4, 2)]


def test_hierarchical_bootstrap(spark):
    rows = [("d", f"i{i}", r, 1.0, 10.0, 3.0) for i in range(40) for r in range(3)]
    h = T.hierarchical_bootstrap(spark.createDataFrame(rows, "d string, item string, rep int, e double, n double, g double"), ["d"], "item", "rep", "e", "n", "g", nboot=200).first()
    assert (h.macro_delta, h.macro_lo, h.corpus_hi, h.macro_sig, h.n_items) == (0.2, 0.2, 0.2, True, 40)


def test_lines_and_media(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(500)))
    got = [r.value for r in S.sampled_lines(spark, f"file://{tmp_path}/a.txt", 20, 3).collect()]
    assert len(set(got)) == 20 and set(got) == {r.value for r in S.sampled_lines(spark, f"file://{tmp_path}/a.txt", 20, 3).collect()}
    (tmp_path / "m").mkdir(), (tmp_path / "m" / "x.wav").write_text("RIFF")
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "stem string, n int")
    assert [r.n for r in S.with_media(rows, "stem", S.listing(spark, f"file://{tmp_path}/m")).collect()] == [1]


SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
from quillon.plans import runtime as R
a, b = R.cut(s.range(5)), R.cut(s.range(7))
R.drop(a, s.range(1))
assert b.count() == 7
R.ship(s)
import os; print("TABLES", len([x for x in os.listdir({folder!r}[7:]) if x.startswith("quillon-")]))
s.stop()
"""


def test_intermediate_tables_are_removed(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=f"file://{tmp_path}")], capture_output=True, text=True, timeout=300)
    assert "TABLES 2" in out.stdout, out.stderr[-2000:]
    assert [x for x in os.listdir(tmp_path) if x.startswith("quillon-")] == []


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as E
    from quillon import queries as core

    monkeypatch.setitem(sys.modules, "quillon.llm.queries", None)
    assert set(E.queries()) == set(core.queries()) and set(E.oracle_sql()) == set(core.oracle_sql())


def test_freeze(spark, tmp_path):
    df = spark.range(5)
    K.freeze(df, "id", f"file://{tmp_path}/f")
    assert K.replay(spark, df, "id", f"file://{tmp_path}/f") and not K.replay(spark, df.union(df.limit(1)), "id", f"file://{tmp_path}/f")
    assert json.loads(K.read_text(spark, f"file://{tmp_path}/f/manifest.json"))["n_ids"] == 5
