"""Problem 1: texts that lost their end.

Intact values of the data are cut artificially to get positives; a hashed logistic regression over closing characters,
punctuation, last words and length-to-limit features is trained on a bounded sample and then scores every record.
"""

from __future__ import annotations

import math
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.lookalike import fold, skeleton
from quillon.plans.runtime import bounded_rows

#: Documented bounds: intact rows the model is fitted on, hashed dimensions, length limits the driver may hold.
TRAIN_ROWS = 12_000
DIMENSIONS = 1 << 17
MAX_LIMITS = 100_000

# Marks that a cut may leave behind.
SIGNS = ("…", "...", " [cut]", "[...]", " […]", " [truncated]", " (cut)", "�", "-", " --", "<", "\\", "&")
SIGN = re.compile(r"\s*(?:\[[^\[\]]{0,14}\]|\([^()\w]{0,4}(?:cut|truncated|abridged)?[^()\w]{0,4}\)|…+|\.{2,}|�+|\s?-{1,3}|[<\\&](?:\w{0,6}))\s*$", re.I)
CLOSERS = ".!?。！？"
QUOTES = "\"'”’»›」』)）]】"
END = re.compile(rf"[{re.escape(CLOSERS)}][{re.escape(QUOTES)}\s]*$")
BREAK = re.compile(r"[.!?](?=\s)|[。！？]|\n")
TOKEN = re.compile(r"[^\W\d_一-鿿]+|\d+|[一-鿿]|[^\w\s]|\s+$")
HAN = re.compile("[一-鿿]")
WORDS = re.compile(r"[^\W_一-鿿]+")
LIST = re.compile(r"\s*(?:\d+[.)]|[-*•])\s")
ALNUM = re.compile(r"[^\W_]")


def clean(text: str) -> str:
    """Folded, with look-alike letters as Latin; only to compute features on."""
    return skeleton(fold(text))


def bare(text: str) -> str:
    """Lower case without closing marks and outer spaces."""
    return text.strip().rstrip(CLOSERS + QUOTES + " ").casefold()


def is_short(text: str) -> bool:
    """A bare name, number or word rather than a sentence."""
    return len(text) <= 7 if HAN.search(text) else len(text) <= 40 and text.strip().count(" ") <= 1


def within(low: str, goal: str) -> bool:
    """Whether a short answer stands in a longer gold as a whole, other than at its start."""
    at = goal.find(low, 1)
    return at > 0 and (low.isdigit() or bool(HAN.search(low)) or not goal[at - 1].isalnum()) and not (goal[at + len(low) : at + len(low) + 1].isalnum() and not HAN.search(low))


def context_of(gold: str | None, instr: str | None) -> tuple[str, str]:
    """Folded gold and question of a record, as the features use them."""
    return clean(gold) if gold else "", clean(instr.rpartition("\n")[2]) if instr else ""


def closed(text: str) -> bool:
    return bool(END.search(text))


def features(text: str, gold: str, question: str, at_limit: bool) -> list[int]:
    """Hashed features of a cleaned text; [] for texts without letter or digit, which are no truncations."""
    if not ALNUM.search(text):
        return []
    out = ["b", f"lim{at_limit}"]
    add = out.append
    m = SIGN.search(text)
    body = text
    if m and m.start():
        sign = m.group().strip()
        body = text[: m.start()]
        add("sign")
        add("sign=" + re.sub(r"\w+", "w", sign))
        add(f"sign&lim{at_limit}")
    elif END.search(text):
        tail = text.rstrip(QUOTES + " \n")
        add("cl=" + tail[-1:])
        add(f"cl&lim{at_limit}")
        if tail[-2:-1].isdigit() and tail[-1] == ".":
            before = TOKEN.findall(tail[-40:-1])[-2:]
            add(f"cl#{before[0] if len(before) > 1 and before[0].islower() else 'X'}")
            add("cl#")
        return [crc32(f.encode()) % DIMENSIONS for f in out]
    else:
        add("open")
        add(f"open&lim{at_limit}")
    if body[-1:].isspace():
        add("space")
    body = body.rstrip()
    if not body:
        return [crc32(f.encode()) % DIMENSIONS for f in out]
    segment = body
    cut = 0
    for b in BREAK.finditer(body, max(0, len(body) - 400)):
        cut = b.end()
    if cut < len(body):
        segment = body[cut:].strip() or body
    tokens = TOKEN.findall(segment)
    shape = ["9" * min(len(t), 5) if t.isdigit() else "X" if t[0].isupper() and (i or len(tokens) == 1) else t.lower() for i, t in enumerate(tokens[:3])]
    ends = ["9" * min(len(t), 5) if t.isdigit() else "X" if t[0].isupper() and i + len(tokens) - 4 > 0 else t.lower() for i, t in enumerate(tokens[-4:], max(0, 4 - len(tokens)))]
    last = tokens[-1] if tokens else ""
    add("multi" if cut else "single")
    add("s1=" + "|".join(ends[-1:]))
    add("s2=" + "|".join(ends[-2:]))
    add("s3=" + "|".join(ends[-3:]))
    add("s4=" + "|".join(ends[-4:]))
    add("op=" + "|".join(shape[:2]) + ">" + "|".join(ends[-1:]))
    add("op2=" + "|".join(shape[:2]) + ">" + "|".join(ends[-2:]))
    add("op3=" + "|".join(shape[:3]) + ">" + "|".join(ends[-3:]))
    add(f"n={min(len(tokens), 14)}|{'|'.join(shape[:2])}")
    add(f"lc={body[-1] if not body[-1].isalnum() else 'h' if HAN.match(body[-1]) else 'd' if body[-1].isdigit() else 'U' if body[-1].isupper() else 'l'}|{bool(cut)}")
    low = bare(body)
    goal = bare(gold) if gold else ""
    if last and not HAN.match(last[-1]) and last[-1].isalnum():
        add("suf=" + last[-3:].lower() + ("U" if last[0].isupper() else "l"))
        add("w=" + last.lower())
        key = last.casefold()
        relation = "none"
        for w in WORDS.findall(gold + " " + question):
            w = w.casefold()
            if w == key:
                relation = "eq"
                break
            if w.startswith(key):
                relation = "pre"
        add(f"cx={relation}|{'U' if last[0].isupper() else 'd' if last[0].isdigit() else 'l'}")
    if HAN.search(segment[-8:]):
        z = re.sub(r"\d+", "9", re.sub(r"[A-Za-zÀ-ÿ]+", "X", segment[-16:]))
        for k in (1, 2, 3, 4, 6):
            add(f"z{k}=" + z[-k:])
    if goal:
        if low == goal:
            add("gold=eq")
        elif goal.startswith(low):
            add("gold=pre" + ("in" if goal[len(low) : len(low) + 1].isalnum() and low[-1:].isalnum() else "out"))
        elif low.endswith(goal):
            add("gold=end")
        elif is_short(body) and within(low, goal):
            add("gold=has")
            at = goal.find(low, 1) + len(low)
            add("gn=" + goal[at : at + 1])
        elif goal in low:
            add("gold=in")
        else:
            part = next((k for k in range(min(len(goal) - 1, len(low)), 0, -1) if low.endswith(goal[:k])), 0)
            add(f"gold=part{min(part, 3)}{'z' if HAN.match(goal[0]) else 'l'}{goal[:1].isdigit()}")
    if question and len(low) > 3:
        q = bare(question)
        if low == q:
            add("q=eq")
        elif q.startswith(low):
            add("q=pre")
        elif low.endswith(q):
            add("q=end")
    return [crc32(f.encode()) % DIMENSIONS for f in out]


def examples(rows, limits: dict, seed: int = 7, group: tuple[str, ...] = ("dataset", "backbone")):
    """(features, label) from intact rows: as they are, without their closing mark, and cut at random places and limits."""
    draw = random.Random(seed)
    wrong = ""
    for r in rows:
        if r["reply"] is None:
            continue
        text = clean(r["reply"])
        gold, question = context_of(r["gold"], r["instr"])
        own = limits.get(tuple(r[g] for g in group), frozenset())
        if not ALNUM.search(text) or SIGN.search(text):
            continue
        is_closed, lines = closed(text), LIST.match(text) and text.count("\n")
        if lines:  # of a list every line but the last is known to be whole
            whole = text.split("\n")
            for n in range(1, lines + 1):
                keep = "\n".join(whole[:n])
                yield features(keep, gold, question, False), 0
            at = len(keep) - draw.randint(1, max(1, len(keep.rpartition("\n")[2]) - 3))
            if ALNUM.search(keep[:at]) and keep[at : at + 1].isalnum() and keep[at - 1].isalpha():
                yield features(keep[:at], gold, question, False), 1
            continue
        short = is_short(text)
        if not is_closed and not (gold and (bare(text) == bare(gold) or short and within(bare(text), bare(gold)))):
            continue  # nothing shows that this value is intact
        if len(r["reply"]) in own and not is_closed:
            continue
        yield features(text, gold, question, is_closed and draw.random() < 0.1), 0
        if not is_closed:  # no gold need be given
            yield features(text, "", question, False), 0
            if short:  # a wrong answer is no cut one
                yield features(text, wrong, question, False), 0
                wrong = gold
        stripped = text.rstrip(CLOSERS + QUOTES + " \n")
        several = bool(BREAK.search(text[:-1]))
        if is_closed and ALNUM.search(stripped) and (not several or draw.random() < 0.4):
            yield features(stripped, gold, question, False), 0
            if draw.random() < 0.3:  # the first sentences of a longer text, as complete replies without a mark
                breaks = [b.start() for b in BREAK.finditer(text[:-1])]
                if breaks:
                    yield features(text[: draw.choice(breaks)], gold, question, False), 0
        places = [(draw.randint(1, max(1, len(stripped) - 1)), False) for _ in range(2 if len(stripped) > 12 else 1)]
        places += [(n, True) for n in sorted(own) if n < len(stripped)]
        for at, hit in places:
            head = text[:at]
            rest = stripped[at:]
            if not ALNUM.search(rest) or not ALNUM.search(head):
                continue
            if closed(head) and not (head[-1] == "." and rest[:1].isdigit()):
                continue
            if rest[0] in CLOSERS and not rest[1:2].isdigit():
                continue
            if short and not (gold and bare(gold).startswith(bare(head))):
                continue  # what is left of a short answer can't be told from another short answer
            if draw.random() < 0.35:
                head = head + draw.choice(SIGNS)
            yield features(head, gold, question, hit or draw.random() < 0.1), 1


def fit(rows, limits: dict, epochs: int = 5, rate: float = 0.35, l2: float = 2e-6, group: tuple[str, ...] = ("dataset", "backbone")) -> np.ndarray:
    """Weights of the logistic regression, by mini-batch Adagrad; the same rows give the same weights."""
    pairs = [x for x in examples(rows, limits, group=group) if x[0]]
    w = np.zeros(DIMENSIONS, dtype=np.float64)
    if not pairs:
        w[crc32(b"b") % DIMENSIONS] = -1.0
        w[crc32(b"sign") % DIMENSIONS] = 3.0
        return w.astype(np.float32)
    order = np.random.default_rng(11)
    flat = np.concatenate([np.asarray(p[0]) for p in pairs])
    ends = np.cumsum([0, *(len(p[0]) for p in pairs)])
    y = np.array([p[1] for p in pairs], dtype=float)
    square = np.full(DIMENSIONS, 1e-2)
    for _ in range(epochs):
        for chunk in np.array_split(order.permutation(len(pairs)), max(1, len(pairs) // 256)):
            where = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in chunk])
            idx = flat[where]
            who = np.repeat(np.arange(len(chunk)), ends[chunk + 1] - ends[chunk])
            p = 1 / (1 + np.exp(-np.bincount(who, weights=w[idx], minlength=len(chunk))))
            g = np.bincount(idx, weights=(p - y[chunk])[who], minlength=DIMENSIONS)
            hit = np.unique(idx)
            gh = g[hit] / 16 + l2 * w[hit]
            square[hit] += gh * gh
            w[hit] -= rate * gh / np.sqrt(square[hit])
    return w.astype(np.float32)


def length_limits(df: DataFrame, text_col: str, group: list[str], least: int = 5, ratio: float = 5.0, shortest: int = 40) -> DataFrame:
    """(group..., n_chars, n): lengths far more frequent in a group than the lengths around them, over all rows."""
    whole = rf"[{CLOSERS}][{re.escape(QUOTES)}\\s]*$"
    is_open = ~F.col(text_col).rlike(whole) | F.col(text_col).rlike(r"\.\.\.\s*$")
    counts = df.where((F.length(text_col) >= shortest) & is_open).groupBy(*group, F.length(text_col).alias("n_chars")).agg(F.count("*").alias("n"))
    around = Window.partitionBy(*group).orderBy("n_chars").rangeBetween(-6, 6)  # a row per length, not per record
    return (
        counts.withColumn("near", (F.sum("n").over(around) - F.col("n")) / 12.0)
        .where((F.col("n") >= least) & (F.col("n") >= ratio * (F.col("near") + 0.5))).drop("near")
    )


def train(df: DataFrame, text_col: str = "reply", gold_col: str = "gold", prompt_col: str = "instr", group: list[str] | None = None, key: str = "row_id", train_rows: int = TRAIN_ROWS):
    """(weights, limits) from the data: limits over all rows, weights from at most about train_rows intact rows."""
    group = group or ["dataset", "backbone"]
    limits: dict = {}
    for r in bounded_rows(length_limits(df, text_col, group), MAX_LIMITS, "length limits"):
        limits.setdefault(tuple(r[g] for g in group), set()).add(r["n_chars"])
    n = df.where(F.col(text_col).isNotNull()).count()
    share = min(1.0, train_rows / max(n, 1))
    unit = F.pmod(F.xxhash64(F.lit("truncation-train"), F.col(key)), F.lit(1 << 20)) / F.lit(1 << 20)
    names = [F.col(text_col).alias("reply"), F.col(gold_col).alias("gold"), F.col(prompt_col).alias("instr"), *(F.col(g).alias(f"group{i}") for i, g in enumerate(group)), F.col(key).alias("key")]
    rows = bounded_rows(df.where(unit < share).select(*names), 4 * train_rows + 1000, "training rows")  # about train_rows of them
    rows.sort(key=lambda r: str(r["key"]))
    return fit(rows, limits, group=tuple(f"group{i}" for i in range(len(group)))), limits


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def score_batch(replies, golds, prompts, groups, weights: list[float], limits: dict) -> list[float | None]:
    """Probability that each reply lost its end; None for null."""
    out: list[float | None] = []
    none: frozenset = frozenset()
    for text, gold, prompt, g in zip(replies, golds, prompts, groups):
        if text is None:
            out.append(None)
            continue
        t = clean(text)
        hit = len(text) in limits.get(g, none)
        if END.search(t) and not hit:
            tail = t.rstrip(QUOTES + " \n")
            if tail[-1:] != "." or not tail[-2:-1].isdigit():
                f = features(t, "", "", False)
                out.append(_sigmoid(sum([weights[i] for i in f])) if f else 0.0)
                continue
        gold_, question = context_of(gold, prompt)
        f = features(t, gold_, question, hit)
        out.append(_sigmoid(sum([weights[i] for i in f])) if f else 0.0)
    return out


def score(df: DataFrame, model, key: str = "row_id", text_col: str = "reply", gold_col: str = "gold", prompt_col: str = "instr", group: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., p_cut) for every record: the probability that the text lost its end, null for a null text.

    Texts without letter or digit get 0; a repeated row gets its score each time. One map over the scan; the model
    (DIMENSIONS floats and the limits) goes to the workers once, as a broadcast of fixed size.
    """
    group = group or ["dataset", "backbone"]
    keep = keep or []
    weights, limits = model
    shared = df.sparkSession.sparkContext.broadcast((weights, limits))
    head = [key, *keep]
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in head)

    def run(batches):
        import pyarrow as pa

        w, lim = shared.value
        w = w.tolist()
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            groups = list(zip(*(col[f"g{i}"].to_pylist() for i in range(len(group)))))
            p = score_batch(col["t"].to_pylist(), col["y"].to_pylist(), col["q"].to_pylist(), groups, w, lim)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(head))), pa.array(p, pa.float64())], names=[*head, "p_cut"])

    cols = [*(F.col(c) for c in head), F.col(text_col).alias("t"), F.col(gold_col).alias("y"), F.col(prompt_col).alias("q"), *(F.col(g).alias(f"g{i}") for i, g in enumerate(group))]
    return df.select(*cols).mapInArrow(run, f"{types}, p_cut double")


def find_truncated(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """Keys of the records whose text lost its end."""
    key = kw.get("key", "row_id")
    return score(df, train(df), **kw).where(F.col("p_cut") >= threshold).select(key)


def truncation_report(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by..., n_texts, n_cut, share_cut): how often each source truncates; null texts are not counted."""
    scored = score(df, train(df), keep=by).where("p_cut is not null")
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_texts"), F.sum((F.col("p_cut") >= threshold).cast("long")).alias("n_cut"), F.avg((F.col("p_cut") >= threshold).cast("double")).alias("share_cut")
    )
