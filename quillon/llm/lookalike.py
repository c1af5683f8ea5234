"""Problem 5: one form for texts that look the same.

Two steps. ``fold`` needs no knowledge of the corpus: it settles width, composition, invisible characters and kinds of
space, and nothing a reader could see. ``Repair`` is the script-aware step: a token that mixes scripts, or is wholly
made of another script's look-alikes, is rewritten in its dominant script where the result is a word of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.runtime import cut, drop

# Letters of Cyrillic, Greek and Armenian drawn like Latin ones.
LATIN_LOOK = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјкорсухԁԛԝһӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικϲϳ" "օսցհ",
        "ABESIJKMHOPCTYXaesijkopcyxdqwhl" "ABEZHIKMNOPTYXovikcj" "ough",
    )
)
# Other punctuation of the same shape.
SAME_SHAPE = {"‐": "-", "‑": "-", "ʼ": "’", "Ϲ": "C"}
# Characters drawn as nothing although not of category Cf, and line separators.
DRAWN_AS_NOTHING = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
VARIATION_SELECTORS = (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
LINE_ENDS = "\x85\u2028\u2029"


def _static_map() -> dict[int, str | None]:
    """Width, radical, space and invisible characters, by their Unicode properties, over all planes."""
    out: dict[int, str | None] = {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        form = unicodedata.decomposition(c)
        if category == "Zs":
            out[code] = " "
        elif category == "Cf" and c != "\u200d":
            out[code] = None
        elif form.startswith(("<wide>", "<narrow>")) or 0x2F00 <= code <= 0x2FD5 or code in (0x2E9F, 0x2EF3):
            out[code] = unicodedata.normalize("NFKC", c)
    out |= dict.fromkeys(map(ord, DRAWN_AS_NOTHING)) | dict.fromkeys(VARIATION_SELECTORS) | dict.fromkeys(map(ord, LINE_ENDS), "\n")
    return out | {ord(a): b for a, b in SAME_SHAPE.items()}


STATIC = _static_map()
_JOINER = re.compile("(?<![\U0001f000-\U0001faff☀-➿️])‍")
_LOOSE = re.compile("[^\x00-\x7fÀ-ÿ一-鿿、。“”…]")


_STATIC = {chr(a): b or "" for a, b in STATIC.items()}


def _static(m: re.Match) -> str:
    c = m.group()
    return _STATIC.get(c, c)


def fold(text: str) -> str:
    """The text with one width, composition and kind of space, and without invisible characters."""
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    if not _LOOSE.search(text):
        return text
    text = _LOOSE.sub(_static, text)
    if "‍" in text:
        text = _JOINER.sub("", text)
    return unicodedata.normalize("NFC", text).replace("\t", " ")


#: Runs of letters other than the signs of Han, Kana and Hangul.
WORD = re.compile("[^\\W\\d_⺀-鿿가-힣豈-﫿𠀀-𯿿]+")
_FOREIGN = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ԰-֏]")


@lru_cache(maxsize=4096)
def script(letter: str) -> str:
    """The script of a letter, by the first word of its name."""
    return unicodedata.name(letter, "?").split(" ")[0]


def suggestions(token: str) -> list[str]:
    """The token rewritten in its dominant script, strongest reading first; empty if it mixes nothing and can't be read otherwise.

    Letters that have no look-alike decide the dominant script; if there are none, Latin is tried, then the other.
    """
    kinds = {script(c) for c in token}
    foreign = kinds & {"CYRILLIC", "GREEK", "ARMENIAN"}
    if not foreign:
        return []
    firm = {script(c) for c in token if c not in LATIN_LOOK and not (script(c) == "LATIN" and c in _BACK)}
    out = []
    if not firm & {"CYRILLIC", "GREEK", "ARMENIAN"}:
        out.append("".join(LATIN_LOOK.get(c, c) for c in token))
    if "LATIN" in kinds and "LATIN" not in firm:
        for s in sorted(foreign):
            out.append("".join(_BACK.get(c, {}).get(s, c) if script(c) == "LATIN" else c for c in token))
    return [x for x in dict.fromkeys(out) if x != token and len({script(c) for c in x}) == 1]


_BACK: dict[str, dict[str, str]] = {}
for _a, _b in LATIN_LOOK.items():
    _BACK.setdefault(_b, {})[script(_a)] = _a


def skeleton(folded: str) -> str:
    """A key on which all texts that look the same agree, whatever the corpus holds; not a form to deliver."""
    return folded if folded.isascii() or not _FOREIGN.search(folded) else folded.translate(_SKELETON)


_SKELETON = {ord(a): b for a, b in LATIN_LOOK.items()}


def odd_tokens(folded: str) -> list[str]:
    """The tokens with letters of the foreign scripts that repair may rewrite."""
    if folded.isascii() or not _FOREIGN.search(folded):
        return []
    return [t for t in dict.fromkeys(WORD.findall(folded)) if suggestions(t)]


def rewrite(folded: str, fixes: dict[str, str]) -> str:
    """The folded text with whole tokens replaced."""
    return WORD.sub(lambda m: fixes.get(m.group(), m.group()), folded) if fixes else folded


def repairs(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(token, fixed): the accepted repairs of all odd tokens in the columns.

    A suggestion is accepted if it is a word of the corpus, that is if it occurs in one script somewhere in the columns,
    and more often than the token itself where the token is of one script. Words are counted in the workers before the
    shuffle; case is ignored. Nulls count for nothing.
    """

    def run(batches):
        for batch in batches:
            odd: dict[str, int] = {}
            words: dict[str, int] = {}
            for i in range(batch.num_columns):
                for text in batch.column(i).to_pylist():
                    if text:
                        t = fold(text)
                        foreign = not t.isascii() and _FOREIGN.search(t)
                        for w in WORD.findall(t):
                            if foreign and _FOREIGN.search(w):
                                odd[w] = odd.get(w, 0) + 1
                            else:
                                words[w] = words.get(w, 0) + 1
            tokens, keys, counts, ranks = [], [], [], []
            for w, n in odd.items():
                s = suggestions(w)
                if len({script(c) for c in w}) == 1:  # also a word of its own script
                    words[w] = words.get(w, 0) + n
                    s = [*s, w] if s else []
                for rank, x in enumerate(s):
                    tokens.append(w), keys.append(x.casefold()), counts.append(0), ranks.append(rank)
            small: dict[str, int] = {}
            for w, n in words.items():
                k = w.casefold()
                small[k] = small.get(k, 0) + n
            for k, n in small.items():
                tokens.append(None), keys.append(k), counts.append(n), ranks.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int32())], names=["token", "word", "n", "rank"])

    found = texts.select(*columns).mapInArrow(run, "token string, word string, n bigint, rank int")
    # one shuffle on the word: its count meets the tokens that would become it; a word is one row per batch beforehand
    by_word = found.groupBy("word").agg(F.sum("n").alias("n"), F.collect_set(F.when(F.col("token").isNotNull(), F.struct("token", "rank"))).alias("from"))
    options = by_word.where((F.size("from") > 0) & (F.col("n") > 0)).select("word", "n", F.explode("from").alias("f")).select("word", "n", "f.token", "f.rank")
    best = options.groupBy("token").agg(F.max(F.struct("n", -F.col("rank"), "word")).alias("b")).select("token", "b.word")

    @F.pandas_udf("string")
    def fixed(tokens, words):
        import pandas as pd

        return pd.Series([next((s for s in suggestions(t) if s.casefold() == w), t) for t, w in zip(tokens, words)], dtype=object)

    return best.withColumn("fixed", fixed("token", "word")).where("fixed <> token").select("token", "fixed")


def _folded(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df's key with, per column, the folded text and its odd tokens: (key..., field, raw, folded, odd)."""
    types = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key]

    def run(batches):
        for batch in batches:
            for j, c in enumerate(columns):
                raw = batch.column(len(key) + j).to_pylist()
                new = [None if t is None else fold(t) for t in raw]
                odd = [[] if t is None else odd_tokens(t) for t in new]
                fields = [batch.column(i) for i in range(len(key))]
                yield pa.RecordBatch.from_arrays(
                    [*fields, pa.array([c] * len(raw), pa.string()), pa.array(raw, pa.string()), pa.array(new, pa.string()), pa.array(odd, pa.list_(pa.string()))],
                    names=[*key, "field", "raw", "folded", "odd"],
                )

    return df.select(*key, *columns).mapInArrow(run, ", ".join([*types, "field string, raw string, folded string, odd array<string>"]))


def _with_fixes(folded: DataFrame, key: list[str], fixes: DataFrame) -> DataFrame:
    """The folded texts with their odd tokens repaired; only texts that have some are joined with the repairs."""
    plain = folded.where(F.size("odd") == 0).select(*key, "field", "raw", F.col("folded").alias("fixed"), F.lit(0).alias("n_repairs"))
    touched = folded.where(F.size("odd") > 0)
    pairs = touched.select("folded", F.explode("odd").alias("token")).distinct()
    maps = pairs.join(fixes, "token").groupBy("folded").agg(F.collect_list(F.struct("token", "fixed")).alias("fixes"))

    @F.pandas_udf("string")
    def apply(texts, lists):
        import pandas as pd

        return pd.Series([t if f is None else rewrite(t, {x["token"]: x["fixed"] for x in f}) for t, f in zip(texts, lists)], dtype=object)

    mended = touched.join(maps, "folded", "left").select(
        *key, "field", "raw", apply("folded", "fixes").alias("fixed"), F.coalesce(F.size("fixes"), F.lit(0)).alias("n_repairs")
    )
    return plain.unionByName(mended)


def unify_texts(df: DataFrame, key: list[str], columns: list[str], vocabulary_columns: list[str] | None = None) -> DataFrame:
    """(key..., field, raw, fixed, n_repairs): every value of the columns in the form that compares equal.

    Null stays null; empty stays empty; repeated rows stay. Texts that look different stay different: case, accents,
    punctuation signs and traditional signs are left as they are.
    """
    df = df.select(*dict.fromkeys([*key, *columns, *(vocabulary_columns or columns)]))
    fixes = cut(repairs(df, vocabulary_columns or columns))
    return _with_fixes(_folded(df, key, columns), key, fixes)


def _same_looking(df: DataFrame, item: list[str], columns: list[str], id_col: str, vocabulary_columns: list[str] | None) -> DataFrame:
    """(k, m, id_col, item..., field): the rows of same-looking texts with several spellings, as a written table.

    k stands for the item, the field and the form, m for the spelling, both 128-bit digests, so that no text is carried
    through a join. Rows are grouped by hashes of the item and of the look of the text first, so that only the few
    groups with more than one spelling are read for the script-aware repair.
    """
    types = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"

    def run(batches):
        for batch in batches:
            for j, c in enumerate(columns):
                ids, items, rows, raws, looks = batch.column(0), batch.column(1), [], [], []
                for i, t in enumerate(batch.column(2 + j).to_pylist()):
                    if t and not t.isspace():
                        look = skeleton(fold(t))
                        rows.append(i), raws.append(t), looks.append(look)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(take), items.take(take), pa.array([c] * len(rows), pa.string()), pa.array(raws, pa.string()), pa.array(looks, pa.string())], names=[id_col, "item", "field", "raw", "look"])

    base = df.select(id_col, F.when(~_any_null(item), F.xxhash64(*item)).alias("item"), *columns).where("item is not null")
    looks = base.mapInArrow(run, f"{types}, item bigint, field string, raw string, look string").select(
        id_col, F.xxhash64("item", "field", "look").alias("g"), F.xxhash64("raw").alias("h"), F.col("field")
    )
    looks = cut(looks)
    # groups with two spellings, counted before the shuffle so that a hot item is one row per task
    two = looks.groupBy("g").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("g")
    wanted = cut(looks.join(two, "g").select(id_col, "field").distinct())
    fixes = cut(repairs(df, vocabulary_columns or columns))
    need = df.select(id_col, *item, *columns).join(wanted.select(id_col).distinct(), id_col)
    fixed = _with_fixes(_folded(need, [id_col, *item], columns), [id_col, *item], fixes).where("fixed rlike '[\\\\p{L}\\\\p{N}]'")
    digest = lambda *cs: F.unhex(F.md5(F.concat_ws("\x1f", *(F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in cs))))
    names = [F.col(c).cast("string") for c in item]
    forms = cut(wanted.join(fixed, [id_col, "field"]).select(id_col, *item, "field", digest(*names, F.col("field"), F.col("fixed")).alias("k"), F.unhex(F.md5("raw")).alias("m")))
    drop(looks, wanted, fixes)
    several = forms.groupBy("k").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo <> hi").select("k")
    return cut(forms.join(several, "k"))


def same_looking_classes(df: DataFrame, item: list[str], columns: list[str], id_col: str = "row_id", vocabulary_columns: list[str] | None = None) -> DataFrame:
    """(item..., field, first_row, n_spellings, n_rows, n_links): the classes of rows of one item whose field looks the same
    but is spelt in several ways; n_links counts the pairs of unequal ones, which are not expanded."""
    rows = _same_looking(df, item, columns, id_col, vocabulary_columns)
    spelt = rows.groupBy("k", *item, "field", "m").agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    per = spelt.groupBy("k", *item, "field").agg(F.min("first").alias("first_row"), F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.select(*item, "field", "first_row", "n_spellings", "n_rows", ((F.col("n_rows") * F.col("n_rows") - F.col("same")) / 2).cast("long").alias("n_links"))


#: Rows of a class from which on its pairs are spread over PAIR_BLOCKS tasks.
PAIR_ROWS = 1_000
PAIR_BLOCKS = 64


def same_looking_pairs(
    df: DataFrame, item: list[str], columns: list[str], id_col: str = "row_id", vocabulary_columns: list[str] | None = None
) -> DataFrame:
    """(row_a, row_b, field): rows of one item whose field is not equal but takes one form, expanded from the classes.

    Null texts, texts without letter or digit and rows with a null item column give no pair. The pairs of a large class
    are split over blocks of its rows, so that no class is expanded by one task.
    """
    rows = _same_looking(df, item, columns, id_col, vocabulary_columns).select(F.col(id_col).alias("row"), "field", "k", "m")
    size = rows.groupBy("k").agg(F.count("*").alias("n"))
    rows = rows.join(size, "k").withColumn("blocks", F.when(F.col("n") > PAIR_ROWS, PAIR_BLOCKS).otherwise(1))
    a = rows.select("k", "field", F.col("row").alias("row_a"), F.col("m").alias("m_a"), F.pmod(F.xxhash64("row"), "blocks").alias("block"))
    b = rows.select("k", F.col("row").alias("row_b"), F.col("m").alias("m_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("block"))
    return a.join(b, ["k", "block"]).where("row_a < row_b and m_a <> m_b").select("row_a", "row_b", "field")


def _any_null(columns: list[str]):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out
