"""Byte-level BPE through the tokenizers library, paid once per distinct pre-token.

The file's pre-tokenizer is a fixed pattern over four character classes (letter, number,
space, other). `split` finds its matches for a whole batch with numpy, in every script, and
`Coder` merges only pre-tokens it has not met. A character's class is proven on the library when
it is first met; texts with characters that the proof can't place, like files of another kind,
go to the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quarry.llm import _bytes as B

LETTER, NUMBER, SPACE, OTHER, FOREIGN, UNMET = 1, 2, 3, 4, 0, 255
MOST_KEPT = 1_000_000
#: Ids that kept pre-tokens may have; scripts without spaces have long ones.
MOST_IDS = 1 << 23
#: Bytes of text that are split at once.
PIECE = 1 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Classes:
    """How the file's own pre-tokenizer treats each character.

    Each guess is proven on the library, once, when the character is first met: a class is kept only
    where the pre-tokenizer joins and splits the character as the class predicts, else it is FOREIGN.
    """

    def __init__(self, path: str):
        splitter = _load(path).pre_tokenizer
        self.cuts = lambda s: len(splitter.pre_tokenize_str(s))
        self.table = np.full(0x110000, UNMET, np.uint8)

    def prove(self, c: str) -> int:
        import regex

        guess = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if regex.match(r"\s", c) else OTHER
        fits = all((self.cuts(x + c) == 1) == (k == guess) for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "#")))
        return guess if fits and (guess != SPACE or self.cuts("\t" + c + "\t") == 1) else FOREIGN

    def of(self, cp: np.ndarray) -> np.ndarray:
        kind = self.table[cp]
        unmet = kind == UNMET
        if unmet.any():
            for x in np.unique(cp[unmet]).tolist():
                self.table[x] = self.prove(chr(x))
            kind = self.table[cp]
        return kind


@lru_cache(4)
def _classes(path: str) -> Classes | None:
    """None: the file is not byte-level BPE of this kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("dropout"):
        return None
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
        return None
    return Classes(path)


@lru_cache(4)
def _specials(path: str) -> list[tuple[str, int]]:
    with open(path, encoding="utf-8") as f:
        return [(t["content"], t["id"]) for t in json.load(f).get("added_tokens", [])]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte's place and code point of each character of UTF-8."""
    char = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[char].astype(np.uint32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        lead, at = cp[wide], char[wide]
        size = 1 + (lead >= 0xE0).astype(np.uint32) + (lead >= 0xF0)
        value = lead & (np.uint32(0x3F) >> size)
        for i in range(1, 4):
            more = np.flatnonzero(size >= i)
            value[more] = (value[more] << 6) | (data[at[more] + i] & 0x3F)
        cp[wide] = value
    return char, cp


def split(data: np.ndarray, off: np.ndarray, char: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pattern's matches in every row, from the place and class of each character."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    byte = data[char]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    m = len(char)
    opens = edge[char]
    closes = np.empty(m, bool)
    closes[-1] = True
    closes[:-1] = opens[1:]
    prev = np.empty(m, np.uint8)
    prev[0] = 0
    prev[1:] = kind[:-1]
    prev[opens] = 0
    follow = np.empty(m, np.uint8)
    follow[-1] = 0
    follow[:-1] = kind[1:]
    follow[closes] = 0
    blank = np.zeros(m, bool)  # a plain space before the character, in the same row
    blank[1:] = byte[:-1] == 32
    blank[opens] = False
    space = kind == SPACE
    start = np.where(space, (prev != SPACE) | ((follow != SPACE) & (follow != 0)), (kind != prev) & ~blank)
    quote = np.flatnonzero((byte == 39) & start & (follow == LETTER))
    if len(quote):
        a = byte[quote + 1]
        b = np.where((quote + 2 < m) & ~closes[quote + 1], byte[np.minimum(quote + 2, m - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        pair = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        start[quote[one | pair] + 1] = False
        size = np.where(one, 2, 3)
        after = (quote + size)[one | pair]
        start[after[after < m]] = True
    begin = char[start]
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:]
    end[-1] = n
    return begin, end


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two tables with keys in order, the first column, as one; they share no key."""
    place = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, place, y) for x, y in zip(a, b, strict=True))


class Coder:
    """Token ids, or only their number, of texts; keeps what it merged, up to a fixed number of pre-tokens."""

    def __init__(self, path: str, ids: bool = True, known: np.ndarray | None = None):
        self.path, self.ids, self.known = path, ids, known
        self.library = _load(path)
        self.classes = _classes(path)
        self.special = [(s.encode(), i) for s, i in _specials(path)]
        self.letters = _byte_letters()
        self.table = {b: ord(c) for b, c in self.letters.items()}
        self.tokenize = self.library.model.tokenize
        self.reset()

    def reset(self) -> None:
        """Two sorted tables of pre-tokens: a large one, and a small one that joins it when it has grown."""
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))] * 2
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def merge(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenize(piece.decode("latin-1").translate(self.table))]

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """Merge new pre-tokens (keys in order) and keep place and number of their ids."""
        size = np.ones(len(keys), np.int32)
        at = np.zeros(len(keys), np.int32)
        whole = np.zeros(len(keys), bool)
        if self.known is not None:
            i = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
            whole = self.known[i] == keys if len(self.known) else whole
        new: list[int] = []
        base = self.used
        rest = np.flatnonzero(~whole).tolist()
        if self.ids:
            for j in rest:
                got = self.merge(raw[j])
                size[j] = len(got)
                at[j] = base + len(new)
                new += got
        else:
            tokenize, table = self.tokenize, self.table
            size[rest] = [len(tokenize(raw[j].decode("latin-1").translate(table))) for j in rest]
        if new:
            if base + len(new) > len(self.pool):
                self.pool = np.concatenate([self.pool[:base], np.zeros(max(len(self.pool) // 2, len(new)), np.uint32)])
            self.pool[base : base + len(new)] = new
            self.used += len(new)
        large, small = self.tables
        small = _merged(small, (keys, at, size))
        if len(small[0]) > 1 << 16 and len(small[0]) * 4 > len(large[0]):
            large, small = _merged(large, small), tuple(a[:0] for a in small)
        self.tables = [large, small]

    def _find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each pre-token."""
        keys, first, back = np.unique(B.span_hash(data, begin, end), return_index=True, return_inverse=True)
        at, size, known = self._kept(keys)
        if not known.all():
            if sum(len(t[0]) for t in self.tables) + int((~known).sum()) > MOST_KEPT or self.used > MOST_IDS:
                self.reset()
                known[:] = False
            f = first[~known]
            self._learn(keys[~known], [data[a:b].tobytes() for a, b in zip(begin[f].tolist(), end[f].tolist(), strict=True)])
            at, size, _ = self._kept(keys)
        return at[back], size[back]

    def _kept(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, size, known = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        for have, where, number in self.tables:
            if len(have):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                at[hit], size[hit] = where[i[hit]], number[i[hit]]
                known |= hit
        return at, size, known

    def _simple(self, data: np.ndarray, off: np.ndarray, char: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Rows that `split` handles: proven characters only and no special string."""
        fine = np.ones(len(off) - 1, bool)
        foreign = char[kind == FOREIGN]
        fine[np.searchsorted(off, foreign, "right") - 1] = False
        if self.special:
            whole = data.tobytes()
            for s, _ in self.special:
                at = whole.find(s)
                while at >= 0:
                    fine[np.searchsorted(off, at, "right") - 1] = False
                    at = whole.find(s, at + 1)
        return fine

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, and all ids one after another (empty if only numbers are wanted)."""
        data, off = B.flat(column)
        counts, out = [], []
        for i, j in B.pieces(off, PIECE):
            c, x = self._rows(data[off[i] : off[j]], off[i : j + 1] - off[i])
            counts.append(c)
            out.append(x)
        none = np.zeros(0, np.uint32)
        return (np.concatenate(counts) if counts else np.zeros(0, np.int64)), (np.concatenate(out) if out else none)

    def _rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.classes is None:
            return self._whole(data, off)
        char, cp = characters(data)
        kind = self.classes.of(cp)
        del cp
        fine = self._simple(data, off, char, kind)
        if fine.all():
            return self._fast(data, off, char, kind)
        runs = np.flatnonzero(np.diff(fine)) + 1
        counts, out = [], []
        for a, b in zip([0, *runs], [*runs, len(fine)], strict=True):
            part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            i, j = np.searchsorted(char, (off[a], off[b]))
            c, x = self._fast(part, o, char[i:j] - off[a], kind[i:j]) if fine[a] else self._whole(part, o)
            counts.append(c)
            out.append(x)
        return np.concatenate(counts), np.concatenate(out)

    def _whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Through the library."""
        texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)]
        got = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.array([len(g) for g in got], np.int64), np.array([t for g in got for t in g], np.uint32) if self.ids else np.zeros(0, np.uint32)

    def _fast(self, data: np.ndarray, off: np.ndarray, char: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = split(data, off, char, kind)
        if not len(begin):
            return np.zeros(len(off) - 1, np.int64), np.zeros(0, np.uint32)
        at, size = self._find(data, begin, end)
        size = size.astype(np.int64)
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        edge = total[np.searchsorted(begin, off)]
        if not self.ids:
            return np.diff(edge), np.zeros(0, np.uint32)
        where = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        return np.diff(edge), self.pool[where]


@lru_cache(2)
def whole_tokens(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary strings that, alone, come out of the merges as one token.

    Not every entry does: an entry whose pieces are merged in another order is left out, so a
    match needs no merging.
    """
    coder = Coder(path)
    back = {c: b for b, c in coder.letters.items()}
    found = []
    for s in coder.library.get_vocab(with_added_tokens=False):
        if all(c in back for c in s) and len(coder.library.model.tokenize(s)) == 1:
            found.append(bytes(back[c] for c in s))
    off = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=off[1:])
    data = np.frombuffer(b"".join(found), np.uint8)
    return np.sort(B.span_hash(data, off[:-1], off[1:]))
