"""Problem 10: oversized texts cut by recursive bisection at their strongest boundaries, with overlaps."""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.bpe import encoder, vocabulary

#: Strength of a cut before a position, by what stands around it; fixed values.
BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD, LETTER = 5, 4, 3, 2, 1, 0
NAMES = ("letter", "word", "clause", "sentence", "line", "blank_line")
#: How far from the midpoint, as a share of the window, a stronger boundary may lie to win over a weaker one at it.
REACH = (0.0, 0.14, 0.30, 0.46, 0.62, 0.78)
# A text may be cut at the end of every match.
BOUNDARIES = {
    BLANK_LINE: re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+(?=[^\r\n])"),
    LINE: re.compile(r"(?:\r\n|\n|\r)(?=[^\r\n])"),
    SENTENCE: re.compile(r"[.!?…。！？;；][”\"»)）\]]*[^\S\r\n]+(?=\S)|[。！？；][”」）]*(?=[^\s”」）])"),
    CLAUSE: re.compile(r"[,:，、：)）\]”\"»][^\S\r\n]+(?=\S)|[，、：](?=\S)"),
    WORD: re.compile(r"[^\S\r\n]+(?=\S)"),
}


def is_sign(c: str) -> bool:
    """Whether a letter is a sign of a script without word spaces."""
    return c > "⺀" and c.isalnum()


def unbroken(text: str, at: int) -> bool:
    """Whether a cut before at leaves combining marks, joiners and surrogate-like pairs whole."""
    return not unicodedata.combining(text[at]) and text[at] not in "‍️" and text[at - 1] != "‍" and not 0x1F3FB <= ord(text[at]) <= 0x1F3FF


class Cutter:
    """Cuts one text after another; sizes are tokens of the encoder."""

    def __init__(self, enc, limit: int, overlap: int):
        if not 0 <= overlap < limit // 2:
            raise ValueError("overlap must be under half the limit")
        self.enc, self.limit, self.overlap = enc, limit, overlap

    def prepare(self, text: str) -> int:
        """Offsets and running token counts of the text; returns its tokens."""
        self.text = text
        self.starts, self.sums, self.inner, self.found = [0], [0], {}, {}
        at = n = 0
        memo, add_start, add_sum = self.enc.memo, self.starts.append, self.sums.append
        for p in self.enc.pieces(text):
            at += len(p)
            n += len(memo.get(p) or self.enc.ids_of(p))
            add_start(at)
            add_sum(n)
        return n

    def upto(self, at: int) -> int:
        """Tokens before a position; inside a pre-token, those that end at or before it."""
        i = bisect.bisect_right(self.starts, at) - 1
        if self.starts[i] == at or i + 1 >= len(self.starts):
            return self.sums[i]
        if i not in self.inner:
            piece = self.text[self.starts[i] : self.starts[i + 1]]
            offsets, ends, n = self.enc.offsets, [], 0
            for t in self.enc.ids_of(piece):
                n += offsets[t + 1] - offsets[t]
                ends.append(n)
            chars, n = [0], 0
            for c in piece:
                n += len(c.encode("utf-8", "surrogatepass"))
                chars.append(n)
            self.inner[i] = ends, chars
        ends, chars = self.inner[i]
        return self.sums[i] + bisect.bisect_right(ends, chars[at - self.starts[i]])

    def alone(self, a: int, b: int) -> int:
        """Tokens of text[a:b] as the tokenizer counts it alone.

        Matching goes from left to right and looks ahead only past white space, so from the start of a pre-token all
        pre-tokens stay as they are but the last: a broken one, and white space at the end, which joins into one.
        """
        i = bisect.bisect_left(self.starts, a)
        if self.starts[i] != a:
            return self.enc.count(self.text[a:b])
        e = b
        while e > a and self.enc.is_space(self.text[e - 1]):
            e -= 1
        j = bisect.bisect_left(self.starts, e)
        n = self.sums[j] - self.sums[i] if self.starts[j] == e else self.sums[j - 1] - self.sums[i] + self.enc.count(self.text[self.starts[j - 1] : e])
        return n + (len(self.enc.ids_of(self.text[e:b])) if e < b else 0)

    def place(self, tokens: int, low: int, high: int) -> int:
        """The first position in [low, high] with at least so many tokens before it, or high."""
        i = bisect.bisect_left(self.sums, tokens)
        if i >= len(self.starts):
            return high
        if i and self.sums[i] - self.sums[i - 1] > 4:  # inside a long pre-token
            a, b = self.starts[i - 1], self.starts[i]
            while a < b:
                mid = (a + b) // 2
                if self.upto(mid) < tokens:
                    a = mid + 1
                else:
                    b = mid
            return min(max(a, low), high)
        return min(max(self.starts[i], low), high)

    def boundaries(self, kind: int) -> list[int]:
        """Positions of one strength in the text, found once."""
        found = self.found.get(kind)
        if found is None:
            found = self.found[kind] = [m.end() for m in BOUNDARIES[kind].finditer(self.text)]
        return found

    def best_cut(self, a: int, b: int) -> tuple[int, int]:
        """Position and strength of the cut of [a, b): strong, and near the midpoint of its tokens."""
        left, right = self.upto(a), self.upto(b)
        edge = max(1, (right - left) // 10)  # either side keeps at least a tenth
        low, mid, high = (self.place(t, a + 1, b - 1) for t in (left + edge, (left + right) // 2, right - edge))
        high = max(high, mid)
        span = max(mid - low, high - mid, 1)
        best = (-1.0, mid, LETTER)
        for kind in (BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD):
            if best[0] >= REACH[kind]:
                break
            places = self.boundaries(kind)
            i = bisect.bisect_left(places, mid)
            for k in (i - 1, i):
                if 0 <= k < len(places) and low <= places[k] <= high:
                    score = REACH[kind] - abs(places[k] - mid) / span
                    if score > best[0]:
                        best = (score, places[k], kind)
        if best[0] < 0:
            return self.plain_cut(low, mid, high)
        return best[1], best[2]

    def plain_cut(self, low: int, mid: int, high: int) -> tuple[int, int]:
        """A cut where nothing pauses near: between signs that stand for words, or outside words and numbers if one of
        their edges is near, in any case beside no combining mark."""
        text = self.text
        whole = None
        for d in range(min(64, max(mid - low, high - mid)) + 1):
            for at in (mid - d, mid + d) if d else (mid,):
                if low <= at <= high and unbroken(text, at):
                    if is_sign(text[at]) and is_sign(text[at - 1]):
                        return at, WORD
                    if not (text[at].isalnum() and text[at - 1].isalnum()):
                        return at, LETTER
                    whole = at if whole is None else whole
        return (mid if whole is None else whole), LETTER

    def cores(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, strength of the cut at start, tokens) of the pieces before overlaps; the first has strength -1."""
        out, room = [], self.limit - self.overlap - 1
        todo = [(0, len(text), -1)]
        while todo:
            a, b, s = todo.pop()
            n = self.upto(b) - self.upto(a)
            if n <= room or b - a <= 1:
                n = self.alone(a, b)  # which may differ at its edges
            if n <= room or b - a <= 1:
                out.append((a, b, s, n))
                continue
            at, how = self.best_cut(a, b)
            todo.append((at, b, how))
            todo.append((a, at, s))
        return out

    def with_overlap(self, before: int, a: int, b: int, n: int) -> tuple[int, int, int]:
        """(start, tokens, tokens of the overlap) once up to overlap tokens of the text since before are put in front."""
        if a == 0 or not self.overlap:
            return a, n, 0
        start = self.place(self.upto(a) - self.overlap, before, a)
        i, j = bisect.bisect_left(self.starts, start), bisect.bisect_left(self.starts, a)
        if i < j:
            start = self.starts[i]
        while start < a and start and not unbroken(self.text, start):
            start += 1
        while start < a:
            over = self.alone(start, a)
            if over <= self.overlap:
                whole = self.alone(start, b)
                if whole < self.limit:
                    return start, whole, over
            i = bisect.bisect_right(self.starts, start)
            start = min(a, self.starts[i]) if i < len(self.starts) else a
        return a, n, 0

    def cut(self, text: str):
        """(start, core_start, end, strength, tokens, overlap tokens) of every piece of an oversized text."""
        before = 0
        for a, b, s, n in self.cores(text):
            start, whole, over = self.with_overlap(before, a, b, n)
            yield start, a, b, s, whole, over
            before = a


def chunk_texts(
    df: DataFrame, limit: int = 256, overlap: int = 32, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k",
    path: str | None = None, keep_small: bool = False,
) -> DataFrame:
    """Pieces (id, piece_no, n_pieces, start_char, core_start, end_char, n_tokens, n_overlap, cut_at, piece) of the texts over limit tokens.

    Every piece has under limit tokens as the tokenizer counts it alone, except a single character that alone has more.
    The cores [core_start, end_char) cover the text without gaps; start_char to core_start repeats at most overlap
    tokens of the piece before. cut_at names the boundary a piece begins at: start, blank_line, line, sentence, clause,
    word, letter. Null, empty and small texts give no row, or with keep_small one row for each non-empty small text.
    A map over the scan: no shuffle, whole texts.
    """
    file, pattern = vocabulary(tokenizer, path)
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece_no", "n_pieces", "start_char", "core_start", "end_char", "n_tokens", "n_overlap", "cut_at", "piece"]

    def run(batches):
        enc = encoder(file, pattern)
        cutter = Cutter(enc, limit, overlap)
        for batch in batches:
            out, size = [[] for _ in names], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = cutter.prepare(text) if text else 0
                if n <= limit:
                    rows = [(0, 0, len(text), -1, n, 0)] if keep_small and text else []
                else:
                    rows = list(cutter.cut(text))
                for i, (start, a, b, s, whole, over) in enumerate(rows):
                    piece = text[start:b]
                    values = (key, i + 1, len(rows), start, a, b, whole, over, NAMES[s] if s >= 0 else "start", piece)
                    for column, v in zip(out, values):
                        column.append(v)
                    size += len(piece)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(c, pa.int32()) for c in out[1:8]), pa.array(out[8], pa.string()), pa.array(out[9], pa.string())], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(c, pa.int32()) for c in out[1:8]), pa.array(out[8], pa.string()), pa.array(out[9], pa.string())], names=names)

    schema = f"`{id_col}` {id_type}, piece_no int, n_pieces int, start_char int, core_start int, end_char int, n_tokens int, n_overlap int, cut_at string, piece string"
    return df.select(id_col, text_col).mapInArrow(run, schema)
