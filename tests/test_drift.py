import json
from collections import defaultdict

import pytest

from quillon.operators import drift as D

SCHEMA = "raw_id long, stream_id long, file_no long, line_no int, body string, field string, kind string"


def table(spark, files):
    """files: {(stream, file): [record or text]}; field and kind are extra columns that clash with inner names."""
    rows = []
    for (s, f), records in files.items():
        for n, r in enumerate(records):
            rows.append((len(rows), s, f, n, r if r is None or isinstance(r, str) else json.dumps(r), "x", "y"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return {tuple(r) for r in D.schema_changes(table(spark, files)).collect()}


def brute(raw):
    """The definition, file by file."""
    fields, values, files = defaultdict(lambda: defaultdict(set)), defaultdict(dict), defaultdict(set)
    for r in raw:
        files[r["stream_id"]].add(r["file_no"])
        o = D.parse_record(r["body"])
        if o is not None:
            key = r["stream_id"], r["file_no"]
            for k, v in D.flatten(o).items():
                fields[key][k].add(D.kind(v))
                values[key].setdefault(D.item_number(o.get("item_id")), {})[k] = v
    out = set()
    for s, fs in files.items():
        fs, last = sorted(fs), {}
        for p, f in zip([None, *fs], fs):
            cur, new_last = fields[s, f], dict(last)
            if p is not None:
                prev = fields[s, p]
                gone, new = set(prev) - set(cur), set(cur) - set(prev)
                both = (set(values[s, p]) & set(values[s, f])) - {None}
                for g in sorted(gone):
                    for n in sorted(new):
                        pairs = [(values[s, p][i].get(g), values[s, f][i].get(n)) for i in both]
                        pairs = [(a, b) for a, b in pairs if a is not None and b is not None]
                        if pairs and all(type(a) is type(b) and a == b for a, b in pairs):
                            out.add((s, f, "renamed", g, n))
                            new_last[n] = last.get(g)
                renamed = [x for x in out if x[:3] == (s, f, "renamed")]
                out |= {(s, f, "removed", g, "") for g in gone - {x[3] for x in renamed}}
                out |= {(s, f, "added", "", n) for n in new - {x[4] for x in renamed}}
                for c in set(cur) & set(prev):
                    now = cur[c] - {None}
                    if now and last.get(c) and last[c] != now:
                        out.add((s, f, "type_changed", c, c))
            for c, ks in cur.items():
                if ks - {None}:
                    new_last[c] = ks - {None}
            last = new_last
    return out


def test_matches_definition(spark, data):
    raw = spark.read.parquet(f"{data}/raw_records.parquet")
    assert {tuple(r) for r in D.schema_changes(raw).collect()} == brute(raw.collect())


def test_kinds_of_change(spark):
    files = {
        (1, 1): [{"item_id": 7, "score": 1, "detail": {"pred": "a"}}, {"item_id": "x#8", "score": 0, "detail": {"pred": None}}],
        (1, 2): [{"item_id": "7", "reward": 1, "detail": {"pred": ["a"]}}, {"item_id": 8, "reward": 0, "cached": True}],
        (1, 4): [{"item_id": 9, "reward": 0.5, "cached": None}, "{broken", None, "[1]"],
        (2, 1): [{"item_id": 1}],
    }
    assert changes(spark, files) == {
        (1, 2, "renamed", "score", "reward"), (1, 2, "added", "", "cached"), (1, 2, "type_changed", "detail.pred", "detail.pred"),
        (1, 4, "removed", "detail.pred", ""), (1, 4, "type_changed", "reward", "reward"), (1, 4, "type_changed", "item_id", "item_id"),
    }


def test_history_goes_over_nulls_and_renames(spark):
    files = {
        (1, 1): [{"item_id": 1, "a": "x"}],
        (1, 2): [{"item_id": 1, "b": "x"}],
        (1, 3): [{"item_id": 1, "b": None}],
        (1, 4): [{"item_id": 1, "b": 3}],
    }
    assert changes(spark, files) == {(1, 2, "renamed", "a", "b"), (1, 4, "type_changed", "b", "b")}


def test_repeated_lines_and_order(spark):
    r = {"item_id": 1, "a": 1}
    assert changes(spark, {(1, 2): [{"item_id": 1, "a": 1, "b": 2}] * 3, (1, 1): [r, r]}) == {(1, 2, "added", "", "b")}


def test_whole_and_fraction(spark):
    assert changes(spark, {(1, 1): ['{"item_id": 1, "a": 1}'], (1, 2): ['{"item_id": 1, "a": 1.0}']}) == {(1, 2, "type_changed", "a", "a")}


def test_empty(spark):
    assert changes(spark, {(1, 1): [None]}) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert D.schema_changes(empty).count() == 0 and D.ingest(empty).count() == 0


def test_ingest_keeps_every_value(spark):
    rows = D.ingest(
        table(spark, {(1, 1): [
            {"item_id": 5, "prompt": "q", "score": "1", "error": {"kind": "T"}, "detail": {"pred": ["a"], "odd": 1}}, {"score": [1, 2]}, "{", None, {"detail": "s"},
        ]}), approved={"prompt": "instr"},
    ).orderBy("raw_id").collect()
    a = rows[0]
    assert (a.item_id, a.instr, a.score, a.pred, json.loads(a.error)) == ("5", "q", 1.0, "a", {"kind": "T"})
    assert json.loads(a.rescued) == {"detail.odd": 1}
    assert rows[1].score is None and json.loads(rows[1].rescued) == {"score": [1, 2]}
    assert not rows[2].valid and rows[2].corrupt == "{" and not rows[3].valid and rows[3].corrupt is None
    assert json.loads(rows[4].rescued) == {"detail": "s"}


def records(spark, files, **kw):
    return {(r.stream_id, r.file_no): r for r in D.ingest(table(spark, files), **kw).collect()}


def test_replay_follows_the_chain_of_its_stream(spark):
    files = {(1, 1): [{"item_id": 1, "reply": "r"}], (1, 2): [{"item_id": 1, "response": "r"}], (1, 3): [{"item_id": 1, "hyp": "r"}], (2, 1): [{"item_id": 1, "hyp": "x"}]}
    r = records(spark, files)
    assert all(r[1, f].reply == "r" and r[1, f].rescued is None for f in (1, 2, 3))
    assert r[2, 1].reply == "x"  # a stream without a history of the name, where the others agree


def test_replay_goes_backwards(spark):
    r = records(spark, {(1, 1): [{"item_id": 1, "answer": "r"}], (1, 2): [{"item_id": 1, "reply": "r"}]})
    assert r[1, 1].reply == "r" and r[1, 1].rescued is None


def test_contradicting_streams_keep_their_own_meaning(spark):
    """out stands for the reply in some streams and for the prediction in others; a third kind of stream can't tell."""
    files = {}
    for s in (1, 2, 3):
        files[s, 1] = [{"item_id": 1, "reply": f"r{s}"}]
        files[s, 2] = [{"item_id": 1, "out": f"r{s}"}]
    for s in (4, 5):
        files[s, 1] = [{"item_id": 1, "detail": {"pred": f"p{s}"}}]
        files[s, 2] = [{"item_id": 1, "out": f"p{s}"}]
    files[6, 1] = [{"item_id": 1, "out": "?"}]
    r = records(spark, files)
    assert [(r[s, 2].reply, r[s, 2].pred) for s in range(1, 6)] == [("r1", None), ("r2", None), ("r3", None), (None, "p4"), (None, "p5")]
    assert (r[6, 1].reply, r[6, 1].pred, json.loads(r[6, 1].rescued)) == (None, None, {"out": "?"})


def test_name_taken_again_for_another_field(spark):
    """In one stream out is the reply first, and the prediction after it was away."""
    files = {
        (1, 1): [{"item_id": 1, "reply": "r"}], (1, 2): [{"item_id": 1, "out": "r"}], (1, 3): [{"item_id": 1, "reply": "r", "detail": {"pred": "p"}}],
        (1, 4): [{"item_id": 1, "reply": "r", "out": "p"}],
    }
    r = records(spark, files)
    assert (r[1, 2].reply, r[1, 2].pred) == ("r", None) and (r[1, 4].reply, r[1, 4].pred) == ("r", "p")


def test_new_fields_are_promoted(spark):
    files = {(1, 1): [{"item_id": 1, "detail": {"lang": "en", "x": 2}}]}
    assert records(spark, files)[1, 1].lang == "en"
    assert json.loads(records(spark, files)[1, 1].rescued) == {"detail.x": 2}
    r = records(spark, files, promoted=(("detail.x", "x", "bigint"),))[1, 1]
    assert r.x == 2 and json.loads(r.rescued) == {"detail.lang": "en"}


@pytest.mark.parametrize(
    "value,to,want",
    [("1_000", "double", None), ("nan", "double", None), ("1_0", "bigint", None), (" 1", "bigint", None), ("1e3", "double", 1000.0), ("12", "bigint", 12), ("2.0", "bigint", 2), ("2.5", "bigint", None),
     ("١", "bigint", None), (["7"], "bigint", 7), (["a", "b"], "string", None), (True, "double", 1.0), (1, "boolean", True), ("TRUE", "boolean", True), (5, "string", "5"), (2**70, "bigint", None), (2**60 + 1, "double", None)],
)
def test_replay_casts(value, to, want):
    assert D.replay_cast(value, to) == ((True, want) if want is not None else (False, None))


def test_odd_characters_survive(spark):
    r = records(spark, {(1, 1): ['{"item_id": "1", "reply": "\\ud800", "x\\u001fy": "\\u0000"}']})[1, 1]
    assert r.reply is None and json.loads(r.rescued) == {"reply": "\ud800", "x\x1fy": "\0"}


def test_values_are_equal_typed_and_rescued(spark):
    """A typed field renamed to an unknown one or back: whole and fractional numbers, text and booleans."""
    cases = [("score", "s2", 1), ("score", "s2", 0.1), ("s1", "score", 1e-7), ("s1", "score", 1e22), ("retries", "n", 3), ("cached", "c", True), ("r", "reply", 'x "y"'), ("reply", "r", "1.50")]
    files, want = {}, set()
    for s, (a, b, v) in enumerate(cases):
        files |= {(s, 1): [{"item_id": 1, a: v}], (s, 2): [{"item_id": 1, b: v}]}
        want.add((s, 2, "renamed", a, b))
    files |= {(99, 1): [{"item_id": 1, "score": 1}], (99, 2): [{"item_id": 1, "x": 1.0}]}
    assert changes(spark, files) == want | {(99, 2, "removed", "score", ""), (99, 2, "added", "", "x")}


@pytest.mark.parametrize("value,want", [(7, "7"), ("ds#007", "7"), ("ds", None), (None, None), (True, None), ("12x", None), ("#0", "0")])
def test_item_number(value, want):
    assert D.item_number(value) == want
