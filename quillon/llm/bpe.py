"""Exact byte-pair encoding by backtracking over Aho-Corasick longest matches.

A greedy longest match is taken at every position and kept only if it is *compatible* with the token before it, that is
if byte-pair merging would really leave the border between the two. An incompatible token is replaced by its next
shorter prefix token; when none is left, the encoder steps back one token and marks the position as a dead end. Every
position is marked at most once, so the work is linear in the text. Decoding reads slices of one joined byte string
through an offset table.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import regex

#: Pre-tokens kept per worker; the memo is emptied when it is full, so memory stays bounded.
MEMO_LIMIT = 150_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class BacktrackingEncoder:
    """Encoder and decoder of a byte-level vocabulary file, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = len(model["merges"]) + 256
        size = min(len(model["vocab"]), special)
        words: list[bytes] = [b""] * size
        ids: dict[bytes, int] = {}
        for text, i in model["vocab"].items():
            if i < size:
                words[i] = to_bytes(text)
                ids[words[i]] = i
        self.split: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            left, right = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            whole = ids[left + right]
            self.split[whole] = pair = (ids[left], ids[right])
            self.merged[pair] = whole
        self.words, self.ids = words, ids
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            machine.add_word(w.decode("latin-1"), i)
        machine.make_automaton()
        self.machine = machine
        shorter = array("i", [-1]) * size
        for i, w in enumerate(words):
            for n in range(len(w) - 1, 0, -1):
                if (j := ids.get(w[:n])) is not None:
                    shorter[i] = j
                    break
        self.shorter = shorter
        self.fits: dict[int, bool] = {}
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.spaces: dict[str, bool] = {}
        self.offsets = array("q", [0])
        for w in words:
            self.offsets.append(self.offsets[-1] + len(w))
        self.joined = b"".join(words)

    # -- pair compatibility ------------------------------------------------------------------------------------------

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two neighbouring tokens."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 2 * MEMO_LIMIT:
                self.fits.clear()
            known = self.fits[key] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        # Undo the merges at the border from the latest to the earliest; a merge over the border that comes before
        # the one just undone would have destroyed the border.
        before = 1 << 40
        while True:
            over = self.merged.get((left, right))
            if over is not None and over < before:
                return False
            deep_left, deep_right = self.split[left][0] != left, self.split[right][0] != right
            if not deep_left and not deep_right:
                return True
            if deep_left and (not deep_right or left > right):
                before, left = left, self.split[left][1]
            else:  # of equal merges the left one comes first, so the right one's border counts as later
                before, right = right + 1, self.split[right][0]

    # -- encoding ----------------------------------------------------------------------------------------------------

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        if len(data) == 1:
            return (self.ids[data],)
        size = len(data)
        longest = [-1] * size
        spans = [0] * size
        for end, token in self.machine.iter(data.decode("latin-1")):
            length = len(self.words[token])
            start = end - length + 1
            if length > spans[start]:
                longest[start], spans[start] = token, length
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.words[token])
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.words[token])
                token = self.shorter[token]
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens, whose concatenation is the text."""
        return self.pattern.findall(text)

    def is_space(self, c: str) -> bool:
        """White space as the pre-token pattern knows it."""
        known = self.spaces.get(c)
        if known is None:
            known = self.spaces[c] = regex.match(r"\s", c) is not None
        return known

    def ids_of(self, piece: str) -> tuple[int, ...]:
        known = self.memo.get(piece)
        if known is None:
            known = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                if len(self.memo) >= MEMO_LIMIT:
                    self.memo.clear()
                self.memo[piece] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give an empty list."""
        out: list[int] = []
        if text:
            memo = self.memo
            for p in self.pattern.findall(text):
                out.extend(memo.get(p) or self.ids_of(p))
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        memo, n = self.memo, 0
        for p in self.pattern.findall(text):
            n += len(memo.get(p) or self.ids_of(p))
        return n

    def decode(self, ids) -> str:
        """The text of a list of ids, by the offset table."""
        joined, offsets = self.joined, self.offsets
        return b"".join(joined[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BacktrackingEncoder:
    """One encoder per Python worker and vocabulary."""
    return BacktrackingEncoder(path, pattern)


def vocabulary(name: str = "byte_bpe_50k", path: str | None = None) -> tuple[str, str]:
    """Path and pre-token pattern of a public byte-level vocabulary; path overrides the installed file."""
    import public_tokenizers

    return path or public_tokenizers.path(f"{name}.json"), public_tokenizers.PATTERN
