import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillon.llm")

from quillon.llm import chunking, defects, encode, leakage, lookalike, mixing, sampling, splits, truncation  # noqa: E402
from quillon.llm import queries as Q  # noqa: E402
from quillon.llm.bpe import encoder, vocabulary  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def enc():
    return encoder(*vocabulary())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, data, name):
    compare(spark, connect(data), data, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, data, name):
    Q.queries()[name](spark, data).collect()


# -- 8 ---------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library(enc, reference):
    draw = random.Random(1)
    letters = "ab thesei 's\n  aaa1234,.;漢字éà👩‍🔬​<|endoftext|>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(3000)]
    texts += [w.decode("utf-8", "ignore") for w in enc.words[::7]] + [" " * 300, "a" * 500, "x1" * 300, "\r\n\r\n \t", "<|endoftext|>"]
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        assert enc.encode(text) == want.ids
        assert enc.decode(want.ids) == text


def test_encode_whole_table(spark, data, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in Q.p8_ids(spark, data).collect()}
    assert got == {k: reference.encode(v or "", add_special_tokens=False).ids for k, v in docs.items()}


def test_encode_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, " ", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_texts(df).collect())
    assert got[:3] == [(1, []), (2, []), (2, [])] and len(got[3][1]) == 1
    assert encode.encode_texts(df.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit,overlap", [(256, 32), (40, 8), (16, 0)])
def test_pieces_cover_the_text(spark, data, enc, limit, overlap):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pieces = {}
    for r in chunking.chunk_texts(docs, limit, overlap).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {k for k, v in texts.items() if v and enc.count(v) > limit}
    for k, ps in pieces.items():
        at = 0
        for n, p in enumerate(sorted(ps, key=lambda p: p.piece_no)):
            assert p.piece_no == n + 1 and p.core_start == at and p.piece == texts[k][p.start_char : p.end_char]
            assert p.n_tokens == enc.count(p.piece) < limit and p.n_overlap == enc.count(texts[k][p.start_char : p.core_start]) <= overlap
            at = p.end_char
        assert at == len(texts[k])


def test_cuts_lie_at_pauses(enc):
    c = chunking.Cutter(enc, 30, 0)
    text = "First part of it is here. " * 4 + "\n\n" + "Second part comes after a pause. " * 4
    assert c.prepare(text) > 30
    assert {chunking.NAMES[s] for _, _, _, s, _, _ in c.cut(text) if s >= 0} <= {"blank_line", "sentence"}
    text = "é" * 400  # hardly a place to cut, and no piece may break a letter
    c.prepare(text)
    assert "".join(text[a:b] for _, a, b, *_ in c.cut(text)) == text


def test_pieces_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert chunking.chunk_texts(df).count() == 0 and chunking.chunk_texts(df, keep_small=True).count() == 1
    with pytest.raises(ValueError):
        chunking.Cutter(None, 10, 5)


# -- 9 ---------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, lang string, doc_kind string, weight double"


def mix_docs(spark, n=3000):
    draw = random.Random(4)
    rows = [(i, "word " * draw.randint(5, 40), "big" if i % 3 else "small" if i % 30 == 0 else "mid", draw.choice(["en", "zh", None]), draw.choice(["a", "b"]), 1.0) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "big", "en", "a", 1.0), (n + 1, "x", None, "en", "a", 1.0), (n + 2, "x", "unlisted", "en", "a", 1.0)], DOCS)


def test_mix_meets_targets(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    docs = mix_docs(spark)
    have = encode.count_tokens(docs.where("source in ('big', 'mid', 'small')")).agg(F.sum("n_tokens")).first()[0]
    mixed = mixing.mix_sources(docs, targets, total_tokens=have / 2).cache()
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    for s, share in (("big", 5 / 9), ("mid", 2 / 9), ("small", 2 / 9)):
        assert abs(report[s].actual_share - share) < 0.02
    assert report["absent"].tokens == 0 and abs(report["absent"].share_gap + 0.1) < 1e-9
    assert abs(sum(r.tokens for r in report.values()) - have / 2) < 0.02 * have
    assert mixed.groupBy("source").agg(F.max("repeats").alias("m")).where("source = 'small'").first().m <= 4
    again = mixing.mix_sources(docs.repartition(7), targets, total_tokens=have / 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_only_caps_limit_the_mix(spark):
    """By default as many tokens as there are: a scarce source gives all it may and falls short, the others don't shrink."""
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("none", 0.1, None)], "source string, target_share double, max_repeats int")
    docs = mix_docs(spark)
    mixed = mixing.mix_sources(docs, targets).cache()
    small = docs.where("source = 'small'").count()
    got = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert (got["small"].n_docs, got["small"].n_taken) == (small, 4 * small) and got["small"].share_gap < 0
    assert abs(got["big"].tokens / got["mid"].tokens - 2.5) < 0.1
    limits = mixing.mix_limits(mixed, docs, targets).collect()
    assert all(r.n_above_cap == 0 for r in limits) and {r.source for r in limits} == {"big", "mid", "small", "none"}
    sides = mixing.mix_marginals(mixed).groupBy("axis").agg(F.sum("actual_share").alias("s")).collect()
    assert len(sides) == 2 and all(abs(r.s - 1) < 1e-9 for r in sides)


def test_mix_keeps_language_shares(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("mid", 0.3, 3)], "source string, target_share double, max_repeats int")
    docs = mix_docs(spark)
    mixed = mixing.mix_sources(docs, targets)
    share = lambda df, w: {r.lang: r.t for r in df.groupBy("lang").agg(F.sum(w).alias("t")).collect()}
    got = share(mixed, F.col("n_tokens") * F.col("repeats"))
    want = share(encode.count_tokens(docs.where("source in ('big', 'mid')")), F.col("n_tokens"))
    for k in want:
        assert abs(got[k] / sum(got.values()) - want[k] / sum(want.values())) < 0.04


def test_mix_edge_cases(spark):
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(mix_docs(spark, 10), targets).count() == 0
    some = spark.createDataFrame([("big", 1.0, 0)], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(mix_docs(spark, 10), some).count() == 0
    assert mixing.mix_sources(mix_docs(spark, 10).limit(0), some).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a,b", [("ＡＢｃ１", "ABc1"), ("é", "é"), ("a​b﻿", "ab"), ("a\xa0b", "a b"), ("⼈", "人"), ("a­b", "ab"), ("☕\ufe0f", "☕"), ("a\U000e0041b", "ab"), ("辻\U000e0100", "辻"), ("a\x85b", "a\nb"), ("a\u2028b", "a\nb"), ("a\u180bb", "ab")])
def test_fold_settles_looks(a, b):
    assert lookalike.fold(a) == lookalike.fold(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("é", "e"), ("…", "..."), ("錄", "录"), ("²", "2"), ("👩‍🔬", "👩🔬"), ("“a”", '"a"'), ("½", "1/2")])
def test_fold_keeps_visible_differences(a, b):
    assert lookalike.fold(a) != lookalike.fold(b)


ROWS = "row_id long, dataset string, item_id string, reply string, gold string, instr string, field string, look string"


def test_same_looking_pairs(spark):
    r = lambda i, item, reply: (i, "d", item, reply, None, "the headphones and the station", "x", "y")
    rows = [r(1, "1", "headphones"), r(2, "1", "hеаdphоnes"), r(3, "1", "headphones"), r(4, "1", "Headphones"), r(5, "2", "hеаdphоnes"), r(6, "1", None), r(7, "1", " "), r(8, "1", "\xa0"), (9, "d", None, "ｘ", None, None, "", ""), r(10, "1", "ｈeadphones")]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted(map(tuple, lookalike.same_looking_pairs(df, ["dataset", "item_id"], ["reply", "gold"], "row_id", ["reply", "instr"]).collect()))
    assert got == [(1, 2, "reply"), (1, 10, "reply"), (2, 3, "reply"), (2, 10, "reply"), (3, 10, "reply")]
    assert lookalike.same_looking_pairs(df.limit(0), ["dataset", "item_id"], ["reply"]).count() == 0
    classes = lookalike.same_looking_classes(df, ["dataset", "item_id"], ["reply", "gold"], "row_id", ["reply", "instr"]).collect()
    assert [tuple(r) for r in classes] == [("d", "1", "reply", 1, 3, 4, 5)]


def test_large_classes_are_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PAIR_ROWS", 5)
    df = spark.createDataFrame([(i, "d", "1", "two words" if i % 2 else "two\xa0words") for i in range(20)], "row_id long, dataset string, item_id string, reply string")
    got = [tuple(r) for r in lookalike.same_looking_pairs(df, ["dataset", "item_id"], ["reply"]).collect()]
    assert len(got) == len(set(got)) == 100 and all(a < b and (a + b) % 2 for a, b, _ in got)


def test_repair_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "Mоscow"), (2, "Моcква Москва Москва"), (3, "Moscow tower"), (4, "qzхv"), (5, None), (6, "")], "row_id long, reply string")
    got = {r.row_id: r.fixed for r in lookalike.unify_texts(df, ["row_id"], ["reply"]).collect()}
    assert got == {1: "Moscow", 2: "Москва Москва Москва", 3: "Moscow tower", 4: "qzхv", 5: None, 6: ""}


def test_pairs_match_brute_force(spark, data):
    rows = Q.items_with_gold(spark, data).select("row_id", "dataset", "item_id", "reply", "gold").collect()
    want = set()
    for f in ("reply", "gold"):
        groups = {}
        for r in rows:
            if r[f] and any(c.isalnum() for c in r[f]):
                groups.setdefault((r.dataset, r.item_id, lookalike.skeleton(lookalike.fold(r[f]))), []).append(r)
        for g in groups.values():
            want |= {(min(a.row_id, b.row_id), max(a.row_id, b.row_id), f) for a in g for b in g if a[f] < b[f]}
    assert {tuple(r) for r in Q.p5_found(spark, data).collect()} == want


# -- 2 ---------------------------------------------------------------------------------------------------------------


def brute_leaks(texts, golds):
    out = set()
    for key, text in texts:
        words = leakage.tokens(text or "")
        joined = "".join(words)
        for item, gold, lang in golds:
            g = leakage.tokens(gold or "")
            if lang == "zh":
                s = "".join(g)
                hit = any(s[i : i + 20] in joined for i in range(len(s) - 19))
            else:
                w = " " + " ".join(words) + " "
                hit = any(" " + " ".join(g[i : i + 10]) + " " in w for i in range(len(g) - 9))
            if hit:
                out.add((key, item))
    return out


def test_leaks_match_brute_force(spark, data):
    golds = [(r.eval_id, r.detail.gold, r.lang) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    got = Q.p2_found(spark, data).collect()
    for name, key, text in (("documents", "doc_id", "text"), ("knowledge_cards", "card_id", "content")):
        texts = [tuple(r) for r in spark.read.parquet(f"{data}/{name}.parquet").select(key, text).collect()]
        assert {(r.holder_id, r.eval_id) for r in got if r.holder == name} == brute_leaks(texts, golds)


def test_leak_forms(spark):
    gold = "The old tower keeps nine silent clocks behind a green door near town"
    zh = "传说梅查尧的渔夫泽格梅在雾里数到40声锣响随后尧叶泽的小船载着829筐梨"
    items = spark.createDataFrame([(1, gold, "en", "t"), (2, zh, "zh", "t"), (3, "too short", "en", "t"), (4, None, "en", "t")], "eval_id long, gold string, lang string, text string")
    texts = [
        gold.upper(), "x " + " ".join(gold.split()[:10]) + " y", " ".join(gold.split()[:9]), "**The** old <b>tower</b>\nkeeps, nine silent clocks behind a green",
        zh, "，".join(zh[:20]), zh[:19], None, "", gold, gold,
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, eval_id int")
    got = sorted((r.holder_id, r.eval_id) for r in leakage.find_leaks(docs, items, "doc_id", "text").collect())
    assert got == [(0, 1), (1, 1), (3, 1), (4, 2), (5, 2), (9, 1), (10, 1)]
    assert leakage.find_leaks(docs.limit(0), items, "doc_id", "text").count() == 0 and leakage.find_leaks(docs, items.limit(0), "doc_id", "text").count() == 0


def changed(draw, w, change):
    """A window with so many substitutions, or one symbol inserted or deleted, not at its ends."""
    w = list(w)
    if change in (1, 2):
        for j in draw.sample(range(len(w)), change):
            w[j] = "龙" if len(w[j]) == 1 else "typo"
    else:
        at = draw.randrange(1, len(w) - 1)
        w[at : at + (change == "delete")] = ["龙" if len(w[0]) == 1 else "more"] if change == "insert" else []
    return w


@pytest.mark.parametrize("change", [1, 2, "insert", "delete"])
@pytest.mark.parametrize("width", [10, 20])
def test_recall_of_windows_that_hold_no_equal_one(width, change):
    """No text holds a window equal to one of its item's; texts that begin and end with the window have a few near ones."""
    draw = random.Random(4)
    most = 1 if change == 1 else 2
    symbols = (lambda: f"w{draw.randint(0, 10**6)}") if width == 10 else (lambda: chr(0x4E00 + draw.randrange(3000)))
    golds = [[symbols() for _ in range(width)] for _ in range(400)]
    side = leakage._Side(width, list(enumerate(golds)), most, leakage.repeats_for(width, most))
    text, owner = [], []
    for i, g in enumerate(golds):
        w = ["0", *changed(draw, g, change), "1"]
        text += w
        owner += [i] * len(w)
    found = side.find(leakage.np.array([leakage.symbol(x) for x in text], dtype=leakage.np.uint64), leakage.np.array(owner), lambda i, j: text[i:j])
    assert all(0 < d <= most for _, _, d in found)
    assert sum(i == j for i, j in {(i, j) for i, j, _ in found}) >= 0.95 * len(golds)


def test_near_leaks_through_the_query(spark):
    draw = random.Random(3)
    golds = [[f"w{draw.randint(0, 10**6)}" for _ in range(10)] for _ in range(100)]
    docs = [(i, " ".join(["before", *changed(draw, g, 2), "after"])) for i, g in enumerate(golds)]
    items = spark.createDataFrame([(i, " ".join(g), "en") for i, g in enumerate(golds)], "eval_id long, gold string, lang string")
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    got = leakage.find_leaks(texts, items, "doc_id", "text", max_edits=2).collect()
    assert sum(r.holder_id == r.eval_id for r in got) >= 0.9 * len(docs)
    assert leakage.find_leaks(texts, items, "doc_id", "text").count() == 0


def test_leaks_in_entities_and_blocks(spark, monkeypatch):
    zh = "传说梅查尧的渔夫泽格梅在雾里数到40声锣响随后尧叶泽的小船载着829筐梨"
    items = spark.createDataFrame([(i, g, "zh") for i, g in enumerate([zh, zh[::-1], zh[3:] + zh[:3], None])], "eval_id long, gold string, lang string")
    docs = spark.createDataFrame([(1, "".join(f"&#{ord(c)};" for c in zh)), (2, "see &amp; " + "".join(f"&#x{ord(c):x};" for c in zh[::-1])), (3, "&" * 40)], "doc_id long, text string")
    whole = sorted(map(tuple, leakage.find_leaks(docs, items, "doc_id", "text").collect()))
    assert {(1, 0), (2, 1)} <= {r[:2] for r in whole} and 3 not in {r[0] for r in whole}
    monkeypatch.setattr(leakage, "MAX_ITEMS", 2)
    assert sorted(map(tuple, leakage.find_leaks(docs, items, "doc_id", "text").collect())) == whole


# -- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,n,m", [(1, 60, 40), (2, 200, 260), (3, 30, 0)])
def test_forest_spans_the_components(spark, seed, n, m):
    draw = random.Random(seed)
    edges = [(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(m)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(None, "a"), ("a", "a")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            parent[find(u)] = find(v)
    forest = splits.spanning_forest(spark.createDataFrame(edges, "u string, v string"))
    got = {r.node: r.root for r in splits.members(forest).collect()}
    assert all(got[r] == r for r in got.values())
    assert set(got) == set(parent)
    assert len({(got[x], find(x)) for x in parent}) == len(set(got.values())) == len({find(x) for x in parent})
    assert forest.count() == len(parent) - len(set(got.values()))


def test_splits_keep_ties_and_shares(spark):
    draw = random.Random(5)
    rows = [(i, "d", f"i{i // 2}", None if draw.random() < 0.1 else "hot" if draw.random() < 0.1 else f"g{draw.randrange(900)}", "x") for i in range(8000)]
    rows += [(-1, None, "i", "g", "x"), (-2, "d", None, "g", "x")]
    df = spark.createDataFrame(rows, "row_id long, dataset string, item_id string, group_id string, root string")
    s = splits.assign_splits(df.where("group_id <> 'hot' or group_id is null"), ["dataset", "item_id"], "group_id")
    j = df.where("group_id <> 'hot'").join(s.drop("root"), ["dataset", "item_id"])
    assert j.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert s.groupBy("dataset", "item_id").count().where("count > 1").count() == 0
    assert {r.split for r in s.collect()} <= {"train", "validation", "test"}
    assert splits.assign_splits(df.limit(0), ["dataset", "item_id"], "group_id").count() == 0


def test_split_shares_of_small_units(spark):
    rows = [(i, "d", f"i{i}", f"g{i // 3}") for i in range(6000)]
    s = splits.assign_splits(spark.createDataFrame(rows, "row_id long, dataset string, item_id string, group_id string"), ["dataset", "item_id"], "group_id")
    share = {r["split"]: r["count"] / 6000 for r in s.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_a_large_unit_is_made_up_for(spark, monkeypatch):
    """A unit of 9 % and one of a third: the other units even the shares out, whatever split the large ones hit."""
    monkeypatch.setattr(splits, "PAIR_MEMBERS", 10)
    rows = [(f"i{i}", "huge" if i < 2000 else "large" if i < 2540 else f"g{i}" if i < 4000 else None) for i in range(6000)]
    rows += [(f"t{i // 2}", f"tie{(i + 1) // 2}") for i in range(60)]  # a chain of groups
    df = spark.createDataFrame([("d", *r) for r in rows], "dataset string, item_id string, group_id string")
    s = splits.assign_splits(df, ["dataset", "item_id"], "group_id")
    n = s.count()
    share = {r["split"]: r["count"] / n for r in s.groupBy("split").count().collect()}
    assert all(abs(share[k] - v) < 0.01 for k, v in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert {r.split for r in s.where("root = 'group:huge'").collect()} == {"train"}
    pairs = splits.tied_pairs(df, ["dataset", "item_id"], "group_id")
    assert pairs.count() == pairs.distinct().count() == 31 * 30 // 2


# -- 4 ---------------------------------------------------------------------------------------------------------------


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(i, "d", f"i{i}", 0.0) for i in range(4000)] + [(-1, None, "i", 0.0)], "row_id long, dataset string, item_id string, u double")
    ids = lambda x: {r.row_id for r in x.collect()}
    few = ids(sampling.stable_sample(df.where("row_id < 2000"), ["dataset", "item_id"], 0.1))
    all_ = ids(sampling.stable_sample(df.repartition(9), ["dataset", "item_id"], 0.1))
    more = ids(sampling.stable_sample(df, ["dataset", "item_id"], 0.2))
    assert few <= all_ <= more and 300 < len(all_) < 500 and -1 not in all_
    assert ids(sampling.stable_sample(df, ["dataset", "item_id"], 0.0)) == set()
    assert len(ids(sampling.stable_sample(df, ["dataset", "item_id"], 1.0))) == 4000
    assert sampling.sample_items(df.limit(0), ["dataset", "item_id"], 0.5).count() == 0


# -- 1 and 6 ---------------------------------------------------------------------------------------------------------

ITEM_ROWS = "row_id long, dataset string, backbone string, reply string, gold string, instr string, kind string, opening string"


def test_truncation_on_held_out_cuts(spark):
    path = "/root/testdata/sf0.01"
    import os

    if not os.path.isdir(path):
        pytest.skip("no test data")
    rows = Q.items_with_gold(spark, path).where("error is null").collect()
    draw = random.Random(8)
    draw.shuffle(rows)
    half = len(rows) // 2
    w = truncation.fit(rows[:half], {}).tolist()
    held = [x for x in truncation.examples(rows[half:], {}, seed=9) if x[0]]
    said = [(sum(w[i] for i in f) > 0, y) for f, y in held]
    hit = sum(a and b for a, b in said)
    assert hit / sum(a for a, _ in said) > 0.95 and hit / sum(b for _, b in said) > 0.93


def test_truncation_edge_cases(spark):
    rows = [(1, "d", "b", None, None, None, "", ""), (2, "d", "b", "", "g", "q", "", ""), (3, "d", "b", "…", "g", "q", "", ""), (4, "d", "b", "x" * 100_000, None, "t\nq?", "", "")]
    df = spark.createDataFrame(rows, ITEM_ROWS)
    got = {r.row_id: r.p_cut for r in truncation.score(df, truncation.train(df)).collect()}
    assert got[1] is None and got[2] == 0.0 and got[3] == 0.0 and got[4] is not None
    assert truncation.find_truncated(df.limit(0)).count() == 0


@pytest.mark.parametrize("reply,want", [
    ("Where is the tower?", True), ("You asked: where is the tower?", True), ("Say it.\nWhere is the tower?", True), ("Where is the tower? In Rome.", False), ("The tower is in Rome.", False), ("", False),
])
def test_copy(reply, want):
    assert defects.is_copy(reply, "Where is the tower?", "Say it.", "Rome") is want


def test_defects(spark):
    draw = random.Random(6)
    kinds = ["Which town hosts the {} festival?", "Why did the {} workshop stop repairing?", "How many bells does {} keep?", "In which year was {} opened?"]
    name = lambda: "".join(draw.choice(["Bel", "mor", "tan", "vik", "sol"]) for _ in range(3))
    rows, n = [], 0
    for i in range(400):
        q = kinds[i // 3 % 4].format(name())
        gold = name()
        reply = "I cannot answer this kind of question today." if i % 10 == 0 else f"The answer for this one is {gold}."
        rows.append((n, "d", "b", reply, gold, "Answer.\n" + q, "", ""))
        n += 1
    extra = [(None, "empty"), ("?!", "empty"), (kinds[0].format("Belmor"), "copy"), ("The answer for this one was found in the", "truncated"), ("Das ist eine Antwort, die niemand versteht.", "other_language")]
    for reply, _ in extra:
        rows.append((n, "d", "b", reply, "Xanadu", "Answer.\n" + kinds[0].format("Belmor"), "", ""))
        n += 1
    rows.append((n, "d", "b", "Das ist eine Antwort, die niemand versteht.", None, None, "", ""))
    df = spark.createDataFrame(rows, ITEM_ROWS)
    texts = ["the answer for this one is which town hosts why did the workshop stop", "das ist eine antwort die niemand versteht und wir auch nicht"]
    labelled = spark.createDataFrame([(i, texts[i % 2], ["en", "de"][i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    got = {(r.row_id, r.defect) for r in defects.find_defects(df, labelled).collect()}
    assert {i for i, d in got if d == "refusal"} == {i for i in range(400) if i % 10 == 0}
    for k, (_, d) in enumerate(extra):
        assert (400 + k, d) in got
    assert not {(n, "copy"), (n, "other_language")} & got
    assert {d for i, d in got if i in (400, 401)} == {"empty"}
    assert defects.find_defects(df.limit(0), labelled).count() == 0


def test_refusals_that_share_words_with_their_question(spark):
    """What a template says is known from other rows, so a question that holds a word of it loses no refusal."""
    draw = random.Random(7)
    kinds = ["Which town hosts the {} festival?", "Why did {} workshop stop repairing?", "How many bells does {} keep?", "In which year was {} opened?"]
    name = lambda: "".join(draw.choice(["Bel", "mor", "tan", "vik", "sol"]) for _ in range(3))
    golds = [name() for _ in range(160)]
    rows = [(i, "d", "b", "Sadly the clip is not something I can hear." if i % 4 == 0 else f"We think of {g} in this one.", g, "Answer.\n" + kinds[i // 4 % 4].format(name()), "", "") for i, g in enumerate(golds)]
    held = [("Sadly the clip is not something I can hear.", "(A) yes (B) no", "The festival"), ("Sadly the clip is not something I can hear.", "Is this right? The tower is old.", "ear"), ("Sadly the clip is not something I can hear!", "What does The Clip say?", None)]
    held += [("Sadly the clip is not something I can hear.", "What is The clip?", "not something I can hear")]  # the answer itself
    rows += [(160 + k, "d", "b", reply, gold, "Answer.\n" + q, "", "") for k, (reply, q, gold) in enumerate(held)]
    labelled = spark.createDataFrame([(i, "the clip is not here", "en") for i in range(40)], "doc_id long, text string, lang string")
    got = {r.row_id for r in defects.find_defects(spark.createDataFrame(rows, ITEM_ROWS), labelled).where("defect = 'refusal'").collect()}
    assert got == {i for i in range(160) if i % 4 == 0} | {160, 161, 162}


def test_short_openings_are_refusals_unless_they_hold_a_name():
    common = {"cannot", "answer", "that", "the", "old"}.__contains__
    assert defects.opening_of("I cannot answer.", "Where is it?", "", "", common)[0] == "i cannot answer"
    assert defects.opening_of("Ervan Teresh.", "Who was it?", "", "", common) is None and defects.opening_of("That.", "Who?", "", "", common) is None
    assert defects.opening_of("我不知道。", "它在哪里", "", "", common)[0] == "我不知道" and defects.opening_of("尧叶泽。", "谁", "", "", common) is None


def test_rare_templates_count(spark):
    rows = [("this can not be told from here", k, True) for k in ("who was", "where is", "when did")] + [("the same answer to one kind", "who was", True)] * 9
    got = defects.refusal_templates(spark.createDataFrame(rows, "opening string, kind string, closed boolean")).collect()
    assert [r.opening for r in got] == ["this can not be told from here"]


def test_templates_without_a_recurring_form_count(spark):
    """Each form occurs once, and the ends of the chain resemble each other only by way of its middle."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(4))
    kinds = ("who was", "where is", "when did")
    base = " ".join(word() for _ in range(14))
    rows = [(f"{base} {word()}", kinds[i % 3], True) for i in range(6)]
    a = [word() for _ in range(40)]
    chain = [" ".join(a[i : i + 30]) for i in (0, 2, 4)]  # 24 of 28 shingles in common, the ends 22 of 30
    assert [len(defects.shingles(x) & defects.shingles(y)) / len(defects.shingles(x) | defects.shingles(y)) >= 0.8 for x, y in ((chain[0], chain[1]), (chain[1], chain[2]), (chain[0], chain[2]))] == [True, True, False]
    rows += [(t, k, True) for t, k in zip(chain, kinds)]
    rows += [(" ".join(word() for _ in range(15)), kinds[i % 3], True) for i in range(30)]
    got = defects.refusal_templates(spark.createDataFrame(rows, "opening string, kind string, closed boolean")).collect()
    assert {r.opening for r in got} == {r[0] for r in rows[:9]} and len({r.cluster for r in got}) == 2


def test_openings_link_like_all_pairs(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice("abcdefghij") * 2 for _ in range(draw.randrange(4, 26))) for _ in range(40)]
    for _ in range(120):
        words = draw.choice(texts).split()
        at = draw.choice([0, -1, draw.randrange(len(words))])
        words[at] = draw.choice("klm")
        texts.append(" ".join(words if draw.random() < 0.5 else [*words, "n"]))
    texts = sorted(set(texts))
    root = {t: t for t in texts}
    for i, x in enumerate(texts):
        for y in texts[:i]:
            a, b = defects.shingles(x), defects.shingles(y)
            if len(a & b) >= 0.8 * len(a | b) and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = {t: low if r == high else r for t, r in root.items()}
    got = {r.opening: r.cluster for r in defects.link_openings(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert got == root and len(set(root.values())) < len(texts)


def test_openings_cluster_on_shingles(spark):
    base = "i am sorry but i have no way to listen to this audio clip at all today"
    near = base.replace("today", "now")
    df = spark.createDataFrame([(base,), (near,), ("something else entirely is said here",)], "opening string")
    got = {r.opening: r.cluster for r in defects.cluster_openings(df, df.limit(2)).collect()}
    assert got[base] == got[near] and got["something else entirely is said here"] not in (base, near)
