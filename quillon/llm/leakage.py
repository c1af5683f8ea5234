"""Problem 2: passages of held-out items inside corpus texts.

Every item-sized window of every text (a run of words, or of letters and digits for unsegmented scripts) is embedded by
the CGK random walk, which maps edit distance to Hamming distance. Positions of the embedded string are sampled a few
times into LSH keys; windows that share a key with a window of an item are compared with it exactly, by edit distance.
A window equal to an item's has the same walk and therefore always collides, so equal windows are found surely; a search
for equal windows is the same search with no edits allowed.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.runtime import bounded_rows

#: Held-out items that are sent out together; more are searched in blocks of about so many, each with a scan of its own.
MAX_ITEMS = 50_000
#: Characters of text embedded at a time in a worker.
SLICE_CHARS = 1_000_000
#: Share of windows at the most edits that the repeats are to find; positions sampled in a repeat; repeats at most.
RECALL = 0.95
NEAR_SAMPLED = 5
MAX_REPEATS = 1_000

WORDS = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>")
HAN = re.compile("[぀-ヿ㐀-鿿豈-﫿]")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, whatever the case, width, markup and encoding of accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return WORDS.findall(text.casefold())


_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cf") + "︀-️]")


class Embedding:
    """A random walk of its own and sampled positions for each repeat; the same seed gives the same keys everywhere."""

    def __init__(self, width: int, repeats: int = 1, sampled: int = 10, seed: int = 5):
        draw = np.random.default_rng(seed + width)
        self.width, self.repeats = width, []
        for _ in range(repeats):
            odd = draw.integers(1, 1 << 62, 2 * width, dtype=np.uint64) | np.uint64(1)
            mix = draw.integers(1, 1 << 62, 2 * width, dtype=np.uint64) | np.uint64(1)
            # the walk reaches the window's end at about step 2 * width: what lies beyond is padding
            self.repeats.append((odd, mix, frozenset(draw.choice(2 * width, min(sampled, 2 * width), replace=False).tolist())))

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """One key per repeat for the windows of width symbols at starts, a repeat at a time."""
        padded = np.concatenate([symbols, np.zeros(1, dtype=np.uint64)])
        for odd, mix, taken in self.repeats:
            at, out = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.uint64)
            for j in range(max(taken) + 1):
                walk = padded[np.where(at < self.width, starts + at, len(symbols))] * odd[j]
                if j in taken:
                    out += (walk ^ (walk >> np.uint64(29))) * mix[j]
                at += (walk >> np.uint64(40) & np.uint64(1)).astype(np.int64)
            yield out


def repeats_for(width: int, most: int, recall: float = RECALL, pairs: int = 1_000, seed: int = 9) -> int:
    """Repeats at which the share recall of random windows at most edits collides, each kind of edits by itself.

    Kinds are most substitutions, and shifts by an insertion or a deletion (two edits of a window) with substitutions for
    the rest. Raises where MAX_REPEATS don't reach the recall. Without edits equal windows always collide in the first.
    """
    if not most:
        return 1
    draw = np.random.default_rng(seed)
    fresh = lambda n: draw.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1)
    kinds = 1 if most < 2 else 3
    windows, changed = [], []
    for n in range(kinds * pairs):
        w = fresh(width)
        v, left = w.copy(), most
        if n % kinds:
            for _ in range(most // 2):
                at = int(draw.integers(width))
                v = np.insert(v, at, fresh(1))[:width] if n % kinds == 1 else np.append(np.delete(v, at), fresh(1))
            left = most % 2
        v[draw.choice(width, min(left, width), replace=False)] = fresh(min(left, width))
        windows.append(w), changed.append(v)
    starts = np.arange(len(windows), dtype=np.int64) * width
    a, b = np.concatenate(windows), np.concatenate(changed)
    embed = Embedding(width, MAX_REPEATS, NEAR_SAMPLED)
    met = np.zeros(len(windows), dtype=bool)
    for r, (x, y) in enumerate(zip(embed.keys(a, starts), embed.keys(b, starts)), 1):
        met |= x == y
        if all(met[k::kinds].mean() >= recall for k in range(kinds)):
            return r
    raise ValueError(f"{MAX_REPEATS} repeats don't reach a recall of {recall} at {most} edits of {width}")


def edits(a, b, most: int) -> int:
    """Edit distance, or most + 1 where it is larger; banded."""
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)) if abs(i - j) <= most else most + 1)
        row = new
    return min(row[-1], most + 1)


class _Side:
    """Items of one kind (words, or letters) with their window keys; a window that several items hold is kept once."""

    def __init__(self, width: int, items: list[tuple[int, list[str]]], most: int, repeats: int):
        self.width, self.most, self.embed = width, most, Embedding(width, repeats, NEAR_SAMPLED if most else 10)
        owners: dict[tuple, set] = {}
        for item, symbols in items:
            for i in range(len(symbols) - width + 1):
                owners.setdefault(tuple(symbols[i : i + width]), set()).add(item)
        self.windows: list[tuple[tuple, list]] = [(w, sorted(own)) for w, own in owners.items()]
        flat = np.array([h for w, _ in self.windows for h in map(symbol, w)], dtype=np.uint64)
        self.buckets: list[dict[int, list[int]]] = []
        self.bits: list[np.ndarray] = []
        for keys in self.embed.keys(flat, np.arange(len(self.windows), dtype=np.int64) * width) if self.windows else []:
            buckets: dict[int, list[int]] = {}
            bits = np.zeros(1 << 18, dtype=bool)
            bits[(keys >> np.uint64(40)).astype(np.int64) & 0x3FFFF] = True
            for n, k in enumerate(keys.tolist()):
                buckets.setdefault(k, []).append(n)
            self.buckets.append(buckets)
            self.bits.append(bits)

    def find(self, symbols: np.ndarray, owner: np.ndarray, words) -> set[tuple[int, int, int]]:
        """(text, item, edits) of the windows that collide and are within the edits; words gives a window's symbols."""
        found: set[tuple[int, int, int]] = set()
        n = len(symbols) - self.width + 1
        if n <= 0 or not self.windows:
            return found
        tried: set[tuple[int, int]] = set()  # candidates of earlier repeats
        starts = np.flatnonzero(owner[:n] == owner[self.width - 1 :])
        for keys, bits, buckets in zip(self.embed.keys(symbols, starts), self.bits, self.buckets):
            for i in np.flatnonzero(bits[(keys >> np.uint64(40)).astype(np.int64) & 0x3FFFF]).tolist():
                near = buckets.get(int(keys[i]))
                if not near:
                    continue
                at = int(starts[i])
                window = tuple(words(at, at + self.width))
                for k in near:
                    if len(self.buckets) > 1:
                        if (at, k) in tried:
                            continue
                        tried.add((at, k))
                    w, items = self.windows[k]
                    d = edits(window, w, self.most)
                    if d <= self.most:
                        found.update((int(owner[at]), item, d) for item in items)
        return found


_BUILT: dict[str, list[_Side]] = {}


def _sides(name: str, make) -> list[_Side]:
    """The index of a search, built once in a worker process and kept for its later tasks; the last search's only."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = make()
    return _BUILT[name]


def symbol(token: str) -> int:
    """A stable non-zero number of a word or letter."""
    return (crc32(token.encode("utf-8", "surrogatepass")) << 1) | 1


def find_leaks(
    texts: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str = "eval_id", gold_col: str = "gold", lang_col: str = "lang",
    n_words: int = 10, n_letters: int = 20, letter_langs: tuple[str, ...] = ("zh",), max_edits: int = 0,
) -> DataFrame:
    """(holder_id, eval_id, edits): texts holding n_words consecutive words of an item's gold, or n_letters letters and digits.

    With max_edits the windows may differ by so many edits (found with a recall of RECALL, see repeats_for); edits is the
    smallest. Null and empty texts and golds, and golds shorter than a window, give no row; every repeated text gives its
    own. The items are a stated set, sent out in blocks of at most about MAX_ITEMS; the texts are scanned once a block,
    whole, without a shuffle.
    """
    have = items.select(F.col(item_col).alias("i"), F.col(gold_col).alias("g"), F.col(lang_col).alias("l")).where("g is not null and i is not null")
    blocks = -(-have.count() // MAX_ITEMS) or 1
    if blocks > 1:
        own = lambda b: items.where(F.pmod(F.xxhash64(item_col), F.lit(blocks * 2)) == b)  # noqa: E731  # half as large as may be: hashes spread unevenly
        parts = [find_leaks(texts, own(b), id_col, text_col, item_col, gold_col, lang_col, n_words, n_letters, letter_langs, max_edits) for b in range(blocks * 2)]
        return reduce(DataFrame.union, parts)
    golds = bounded_rows(have, MAX_ITEMS, "held-out items")
    by_words = [(r["i"], tokens(r["g"])) for r in golds if r["l"] not in letter_langs]
    by_letters = [(r["i"], list("".join(tokens(r["g"])))) for r in golds if r["l"] in letter_langs]
    shared = texts.sparkSession.sparkContext.broadcast((by_words, by_letters, repeats_for(n_words, max_edits), repeats_for(n_letters, max_edits) if by_letters else 1))
    name = uuid.uuid4().hex
    type_id, type_item = texts.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def make():
            words_, letters_, many_words, many_letters = shared.value
            return [_Side(n_words, words_, max_edits, many_words), _Side(n_letters, letters_, max_edits, many_letters)]

        sides = _sides(name, make)
        only_han = all(HAN.search("".join(w)) for w, _ in sides[1].windows)
        known: dict[str, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            values = batch.column(1).to_pylist()
            found: set[tuple[int, int, int]] = set()
            at = 0
            while at < len(values):
                words: list[str] = []
                word_owner, letters, letter_owner = [], [], []
                size = 0
                while at < len(values) and size < SLICE_CHARS:
                    t = values[at]
                    if t:
                        size += len(t)
                        own = tokens(t)
                        words += own
                        word_owner += [at] * len(own)
                        if sides[1].windows and (not only_han or not t.isascii() or "&" in t):  # entities may write signs
                            run_on = "".join(own)
                            if not only_han or HAN.search(run_on):
                                letters.append(run_on)
                                letter_owner.append(at)
                    at += 1
                if words and sides[0].windows:
                    if len(known) > 400_000:
                        known.clear()
                    for w in set(words):
                        if w not in known:
                            known[w] = symbol(w)
                    numbers = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
                    found |= sides[0].find(numbers, np.asarray(word_owner, dtype=np.int64), lambda i, j, w=words: w[i:j])
                if letters and sides[1].windows:
                    joined = "".join(letters)
                    codes, back = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
                    numbers = np.array([symbol(chr(c)) for c in codes], dtype=np.uint64)[back]
                    owner = np.repeat(np.asarray(letter_owner, dtype=np.int64), [len(x) for x in letters])
                    found |= sides[1].find(numbers, owner, lambda i, j, s=joined: s[i:j])
            best: dict[tuple[int, object], int] = {}
            for row, item, d in found:
                best[row, item] = min(d, best.get((row, item), d))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r for r, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()) if type_item == "bigint" else pa.array([i for _, i in best]), pa.array(list(best.values()), pa.int32())],
                names=["holder_id", "eval_id", "edits"],
            )

    return texts.select(id_col, text_col).where(F.length(text_col) >= min(n_words, n_letters)).mapInArrow(run, f"holder_id {type_id}, eval_id {type_item}, edits int")


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(eval_id, dataset, holder_kinds..., n_texts): a row per held-out item, 0 where it did not leak."""
    counts = found.groupBy("eval_id").agg(F.sum((F.col("holder") == "documents").cast("long")).alias("n_documents"), F.sum((F.col("holder") == "knowledge_cards").cast("long")).alias("n_cards"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return items.select("eval_id", "dataset", "item_id").join(counts, "eval_id", "left").select("eval_id", "dataset", "item_id", zero("n_documents"), zero("n_cards"))


def union_holders(parts: dict[str, DataFrame]) -> DataFrame:
    """(holder, holder_id, eval_id, edits) of several scanned tables."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("holder"), "holder_id", "eval_id", "edits") for name, df in parts.items()))
