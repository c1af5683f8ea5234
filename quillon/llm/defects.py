"""Problem 6: broken prompt and response pairs, each with its defects.

Refusals are found without a phrase list: response openings are clustered by verified shingles, and a cluster that recurs
across unrelated kinds of questions, holds nothing of the question or its gold and ends its sentence is a refusal
template. Empty replies, cut replies (the truncation model), copies and other languages are labelled by checks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import truncation
from quillon.llm.splits import members, spanning_forest
from quillon.llm.truncation import ALNUM, CLOSERS, HAN, QUOTES, WORDS, bare, clean
from quillon.plans.runtime import bounded_rows, broadcast_if_small, cut

#: Documented bound: labelled texts the language model is fitted on.
LANGUAGE_TEXTS = 3_000
MAX_LANGUAGE_WORDS = 200_000

SENTENCE = re.compile(r"(.*?(?:[.!?](?=\s|$)|[。！？!?](?=[^\s]|$)|\n|$))", re.S)
# Words that ask, and particles of sentences, in unsegmented Chinese.
ASKING = ("为什么", "哪一年", "多长时间", "多少", "什么", "哪个", "哪里", "怎么", "谁", "吗", "几")
PARTICLES = frozenset("的在是于了有和因为不没请无法我您它这那就都把被由归举办")


def flat(text: str) -> str:
    """Letters and digits only, in lower case and without accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return "".join(WORDS.findall(text.casefold())) if not HAN.search(text) else re.sub(r"[\W_]+", "", text.casefold())


# -- languages -------------------------------------------------------------------------------------------------------


def trigrams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Languages:
    """Naive Bayes over lower-case words, and over the trigrams of words that aren't known, for languages written with
    letters; signs of Han count on their own."""

    def __init__(self, words: dict[str, dict[str, float]], grams: dict[str, dict[str, float]], names: list[str], han: str | None):
        self.words, self.grams, self.names, self.han = words, grams, names, han

    def evidence(self, text: str, skip: frozenset[str] = frozenset()) -> tuple[str | None, float, int, dict[str, float]]:
        """(language, margin over the next, words known, scores); None where nothing speaks for a language."""
        scores = dict.fromkeys(self.names, 0.0)
        known = 0
        for w in WORDS.findall(text):
            if w[0].isdigit() or w in skip:
                continue
            own = self.words.get(w)
            if own is None and w[0].isupper():
                own = self.words.get(w.lower())
                if own is None:
                    continue  # a name, or a word that only starts a sentence
            known += 1
            if own is not None:
                for n, v in own.items():
                    scores[n] += v
            else:
                parts = [g for g in map(self.grams.get, trigrams(w)) if g]
                for g in parts:
                    for n, v in g.items():
                        scores[n] += v / (len(parts) + 1)
        han = len(HAN.findall(text))
        if self.han and han >= 4 and han >= 2 * known and (han >= 10 or any(c in PARTICLES for c in text)):
            return self.han, float(han), han, scores
        if known < 1:
            return None, 0.0, 0, scores
        best, second = sorted(scores.items(), key=lambda x: -x[1])[:2] if len(scores) > 1 else (*scores.items(), (None, 0.0))
        return best[0], best[1] - second[1], known, scores


def learn_languages(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", n_texts: int = LANGUAGE_TEXTS) -> Languages:
    """Word weights from at most about n_texts labelled texts, chosen by the hash of their key; counted on the executors."""
    have = texts.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = min(1.0, n_texts / max(1, have.count()))
    chosen = have.where(F.pmod(F.xxhash64(F.lit("languages"), F.col(key)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    words = F.array_distinct(F.expr(f"regexp_extract_all(`{text_col}`, '(?<![\\\\p{{L}}\\\\p{{N}}])[\\\\p{{Ll}}]+(?![\\\\p{{L}}\\\\p{{N}}])', 0)"))
    counts = chosen.select(F.col(lang_col).alias("lang"), F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).where("n >= 3")
    rows = bounded_rows(counts, MAX_LANGUAGE_WORDS, "language words")
    totals = {r["lang"]: r["n"] for r in bounded_rows(chosen.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), ), 1000, "languages")}
    signs = {r["lang"]: r["s"] for r in bounded_rows(chosen.groupBy(F.col(lang_col).alias("lang")).agg(F.avg(F.expr(f"cast(`{text_col}` rlike '[一-鿿]{{4}}' as int)")).alias("s")), 1000, "languages")}
    han = max(signs, key=lambda k: signs[k]) if signs and max(signs.values()) > 0.5 else None
    names = sorted(n for n in totals if n != han)
    table: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["lang"] in names and len(r["w"]) < 30:
            table.setdefault(r["w"], {})[r["lang"]] = r["n"]
    grams: dict[str, dict[str, float]] = {}
    for w, n in table.items():  # types rather than occurrences, in the language a word is commonest in
        for g in set(trigrams(w)):
            own = grams.setdefault(g, {})
            top = max(n, key=lambda k: n[k] / totals[k])
            own[top] = own.get(top, 0) + 1

    def weigh(counts: dict[str, dict[str, float]], sizes: dict[str, float], least: float) -> dict[str, dict[str, float]]:
        out = {}
        for w, n in counts.items():
            p = {k: np.log((n.get(k, 0) + least) / (sizes[k] + 1.0)) for k in names}
            mean = sum(p.values()) / len(p)
            out[w] = {k: float(np.clip(v - mean, -3, 3)) for k, v in p.items()}
        return out

    sizes = {k: sum(g.get(k, 0) for g in grams.values()) for k in names}
    return Languages(weigh(table, totals, 0.05), weigh(grams, sizes, 0.5), names, han)


# -- checks of one pair ----------------------------------------------------------------------------------------------


def question_kind(question: str) -> str:
    """A coarse kind of question: how it asks, not about what."""
    if HAN.search(question):
        return next(("z" + a for a in ASKING if a in question), "z" + re.sub(r"[^一-鿿]", "", question)[-2:])
    return " ".join(w.lower() for w in WORDS.findall(question)[:2])


def opening_of(text: str, question: str, gold: str, task: str, common: Callable[[str], bool] = lambda w: False) -> tuple[str, bool, bool] | None:
    """(first sentence without its mark, whether it had one, whether it holds nothing of the question or gold), None for what
    can't be a refusal.

    Sentences with digits, and such that hold the whole gold, are answers rather than templates; so are sentences of one
    word, and of under four words or seven signs if they hold a word that isn't a common one of the language (a name).
    Only openings that hold nothing of their question or gold may form a template, but whatever single words they share
    with them, they may match one.
    """
    first = SENTENCE.match(text.strip()).group(1).strip()
    key = first.rstrip(CLOSERS + QUOTES + " ").strip().casefold()
    if any(c.isdigit() for c in key) or not key or not key[-1].isalnum():
        return None
    words = WORDS.findall(key)
    if HAN.search(key):
        if len(key) < 7 and (len(key) < 4 or not any(c in PARTICLES for c in key)):
            return None
        context = f"{question} {gold}".casefold()
        free = not any(w in context for w in words if not HAN.search(w)) and not any(HAN.match(a) and HAN.match(b) and a + b in context for a, b in zip(key, key[1:]))
    else:
        if len(words) < 4 and (len(words) < 2 or not all(w == "i" or common(w) for w in words)):
            return None
        names = {w.casefold() for w in WORDS.findall(f"{question} {gold}") if w[0].isupper()} - {w.casefold() for w in WORDS.findall(question)[:1]}
        free = not any(w in names for w in words[1:])
    if task and key == task.strip().rstrip(CLOSERS + " ").casefold():
        return None
    known = bare(gold) if gold else ""
    if len(known) > (1 if HAN.search(key) else 2):
        if key in known or known in key and (HAN.search(key) or re.search(rf"(?<!\w){re.escape(known)}(?!\w)", key)):
            return None
        free = free and (bool(HAN.search(key)) or known not in key)
    return key, first.rstrip(QUOTES + " \n")[-1:] in tuple(CLOSERS), free


def is_copy(text: str, question: str, task: str, gold: str) -> bool:
    """Whether the reply repeats the question, perhaps after a lead-in or the task line, and answers nothing."""
    q = flat(question)
    if len(q) < 5:
        return False
    r = flat(text)
    if len(r) < len(q) or q not in r:
        return False
    t = flat(task)
    before, _, after = r.rpartition(q)
    if t:
        before, after = before.replace(t, ""), after.replace(t, "")
    before, after = before.replace(q, ""), after.replace(q, "")
    if len(after) > 1:
        return False
    answer = flat(gold)
    return len(before) <= 40 and not (len(answer) > 2 and answer in before and answer not in q)


def other_language(text: str, question: str, gold: str, languages: Languages, task: str = "") -> bool:
    """Whether the reply's sentences are in another language than the question.

    Names, numbers and option letters say nothing; a single foreign word among those of the question's language is
    outweighed; at least two known words, or a sentence of signs, must speak for the other language.
    """
    asked, margin, n, _ = languages.evidence(question)
    if asked is None or margin < 1.0:
        return False
    if task and task in text:
        text = text.replace(task, " ")
    names = frozenset(w for w in WORDS.findall(f"{question} {gold}") if w[0].isupper())
    got, lead, known, scores = languages.evidence(text, names)
    if got is None or got == asked:
        return False
    if got == languages.han:
        return True
    if asked == languages.han:
        return known >= 3 and known > len(HAN.findall(text))
    return known >= 2 and scores[got] - scores[asked] > 2.5


# -- clusters of openings --------------------------------------------------------------------------------------------

def shingles(key: str, size: int = 5) -> frozenset[int]:
    """Hashes of runs of five words, or five signs of unsegmented text; a shorter text is one shingle."""
    units = [c for c in key if not c.isspace()] if HAN.search(key) else WORDS.findall(key)
    if len(units) <= size:
        return frozenset([crc32(" ".join(units).encode())])
    return frozenset(crc32(" ".join(units[i : i + size]).encode()) for i in range(len(units) - size + 1))


def rare_shingles(openings: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(opening, bucket): of the n shingles of a distinct opening the n - ceil(similarity n) + 1 that fewest openings have.

    Two openings at the similarity have one of these in common whatever they are, so buckets lose no pair; shingles that
    only one opening has make none.
    """

    def cut_up(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(k, x) for k in b.column(0).to_pylist() for x in shingles(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["opening", "shingle"])

    s = cut(openings.select("opening").distinct().mapInArrow(cut_up, "opening string, shingle bigint"))
    n = s.groupBy("shingle").agg(F.count("*").alias("n"))
    ordered = s.join(n, "shingle").groupBy("opening").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))  # of one opening
    most = F.size("s") - F.ceil(F.lit(similarity) * F.size("s") - 1e-9).cast("int") + 1
    return ordered.select("opening", F.explode(F.slice("s", F.lit(1), most)).alias("s")).where("s.n > 1").select("opening", F.col("s.shingle").alias("bucket"))


def resembles(a: frozenset[int], b: frozenset[int], similarity: float) -> bool:
    return len(a & b) >= similarity * len(a | b)


def link_openings(openings: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(opening, cluster): distinct openings, those tied by a chain of pairs at the similarity with the smallest of them.

    A bucket streams through in order. An opening is compared with the groups the bucket has so far, with each until one
    member resembles it, and gives one link for each; so a bucket whose openings are alike costs one comparison each.
    """

    def run(batches):
        import pyarrow as pa

        here, groups = None, []
        for b in batches:
            links = []
            for k, bucket in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != here:
                    here, groups = bucket, []
                own = shingles(k)
                near = [g for g in groups if any(resembles(own, x, similarity) for x in g[1])]
                links += [(g[0], k) for g in near]
                if not near:
                    groups.append((k, {own: None}))
                    continue
                for g in near[1:]:
                    near[0][1].update(g[1])
                near[0][1][own] = None
                if len(near) > 1:
                    groups = [g for g in groups if not any(g is x for x in near[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in links], pa.string()), pa.array([r[1] for r in links], pa.string())], names=["u", "v"])

    every = openings.select("opening").distinct()
    links = rare_shingles(every, similarity).select("opening", "bucket").repartition("bucket").sortWithinPartitions("bucket", "opening").mapInArrow(run, "u string, v string")
    tied = members(spanning_forest(links)).select(F.col("node").alias("opening"), F.col("root").alias("cluster"))
    return every.join(tied, "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))


def cluster_openings(openings: DataFrame, leaders: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(opening, cluster): distinct openings put to the leaders that they resemble.

    Common rare shingles give the candidates of each leader, so a bucket is joined with its leaders and never paired off;
    candidates are verified on their shingles. Of several leaders at the similarity the smallest counts, so leaders that
    resemble each other fall together; an opening that resembles none stays alone.
    """

    @F.pandas_udf("boolean")
    def alike(xs, ys):
        import pandas as pd

        return pd.Series([resembles(shingles(x), shingles(y), similarity) for x, y in zip(xs, ys)], dtype=bool)

    every = openings.select("opening").distinct()
    led = leaders.select("opening").distinct()
    keys = cut(rare_shingles(every.union(led), similarity))
    lead = cut(keys.join(led, "opening", "left_semi").withColumnRenamed("opening", "lead"))
    pairs = keys.join(every, "opening", "left_semi").join(broadcast_if_small(lead), "bucket").select("opening", "lead").distinct()
    # an opening that is a leader itself may have no bucket, as no other has its shingles
    best = pairs.where(alike("opening", "lead")).union(every.join(led, "opening", "left_semi").select("opening", F.col("opening").alias("lead"))).groupBy("opening").agg(F.min("lead").alias("cluster"))
    return every.join(best, "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))


def refusal_templates(openings: DataFrame, min_kinds: int = 3, max_share: float = 0.6, min_rows: int = 3) -> DataFrame:
    """(opening, cluster) of the clusters that recur across unrelated questions.

    openings: (opening, kind, closed), a row per reply. A cluster is all openings that are tied by pairs at the similarity,
    whether or not a form of it recurs. It counts if its sentence was finished in most replies, if at least min_rows
    replies to min_kinds kinds of questions have it, and no kind has more than max_share of them.
    """
    per = openings.groupBy("opening", "kind").agg(F.count("*").alias("n"), F.sum(F.col("closed").cast("long")).alias("closed"))
    per = cut(per)
    clusters = cut(link_openings(per))
    kinds = per.join(clusters, "opening").groupBy("cluster", "kind").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"))
    spread = kinds.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"), F.max("n").alias("top"), F.count("*").alias("kinds"))
    good = spread.where((F.col("n") >= min_rows) & (F.col("kinds") >= min_kinds) & (F.col("top") <= max_share * F.col("n")) & (2 * F.col("closed") >= F.col("n")))
    return clusters.join(good.select("cluster"), "cluster").select("opening", "cluster")


# -- the operator ----------------------------------------------------------------------------------------------------


def find_defects(
    df: DataFrame, labelled: DataFrame, key: str = "row_id", threshold: float = 0.5, text_col: str = "reply", gold_col: str = "gold", prompt_col: str = "instr", group: list[str] | None = None
) -> DataFrame:
    """(key, defect) with defect empty, truncated, refusal, copy or other_language; a row may have two or more.

    df should hold the rows without error. labelled (text, lang, doc_id) teaches the languages. A null prompt gives
    neither copy nor other_language; a null gold is no gold; an empty or null reply is empty and nothing else. Replies
    are read once by one map; only the few rows that show something are shuffled.
    """
    group = group or ["dataset", "backbone"]
    weights, limits = truncation.train(df, text_col, gold_col, prompt_col, group, key)
    shared = df.sparkSession.sparkContext.broadcast((weights, limits, learn_languages(labelled)))
    type_ = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        w, lim, languages = shared.value
        w = w.tolist()
        for b in batches:
            ids, replies, golds, prompts, *groups = (c.to_pylist() for c in b.columns)
            p = truncation.score_batch(replies, golds, prompts, list(zip(*groups)), w, lim)
            out: list[tuple] = []
            for i, text, gold, prompt, score in zip(ids, replies, golds, prompts, p):
                t = clean(text) if text else ""
                if not ALNUM.search(t):
                    out.append((i, "empty", None, None, None, None))
                    continue
                is_cut = score is not None and score >= threshold
                if is_cut:
                    out.append((i, "truncated", None, None, None, None))
                task, _, question = clean(prompt).rpartition("\n") if prompt else ("", "", "")
                gold = clean(gold) if gold else ""
                if prompt:
                    if is_copy(t, question, task, gold):
                        out.append((i, "copy", None, None, None, None))
                    if other_language(t, question, gold, languages, task):
                        out.append((i, "other_language", None, None, None, None))
                o = opening_of(t, question, gold, task, languages.words.__contains__)
                if o:
                    g = flat(gold)
                    answered = len(g) > 2 and g in flat(t)[len(flat(o[0])) :]
                    if not answered:
                        out.append((i, "open" if is_cut and not o[1] else "maybe", o[0], question_kind(question) if prompt else None, *o[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], b.column(0).type), *(pa.array([r[j] for r in out], t) for j, t in ((1, pa.string()), (2, pa.string()), (3, pa.string()), (4, pa.bool_()), (5, pa.bool_())))],
                names=[key, "what", "opening", "kind", "closed", "free"],
            )

    seen = cut(df.select(key, text_col, gold_col, prompt_col, *(F.col(g).alias(f"g_{g}") for g in group)).mapInArrow(run, f"`{key}` {type_}, what string, opening string, kind string, closed boolean, free boolean"))
    plain = seen.where("opening is null").select(key, F.col("what").alias("defect"))
    templates = cut(refusal_templates(seen.where("free and kind is not null").select("opening", "kind", "closed")))
    # the openings that may form no template, as they hold something of their question, are put to the accepted ones
    held = seen.where("what = 'maybe' and (not free or kind is null)").select("opening").distinct().join(templates, "opening", "left_anti")
    alike = cluster_openings(held, templates).where("cluster <> opening")
    whole = seen.where("what = 'maybe'").join(templates.select("opening").union(alike.select("opening")), "opening").select(key)
    # a refusal that was cut is the beginning of a template; an opening is joined with all beginnings of the templates
    size = F.length("opening")
    starts = templates.select(F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("opening", F.lit(1), i))).alias("opening")).distinct()
    broken = seen.where("what = 'open'").join(broadcast_if_small(cut(starts)), "opening", "left_semi").select(key)
    refusals = whole.union(broken).distinct().withColumn("defect", F.lit("refusal"))
    return plain.union(refusals)


def defect_report(found: DataFrame, df: DataFrame, by: list[str], key: str = "row_id") -> DataFrame:
    """(by..., defect, n): defects of each source."""
    return df.select(key, *by).join(found, key).groupBy(*by, "defect").agg(F.count("*").alias("n"))
