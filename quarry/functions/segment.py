"""Words of texts that are written without spaces: the most probable path through the words a table of frequencies knows.

Every run of characters is a graph: an edge for each known word, and one for each single character, which counts as seen once
where it is not known. The path whose probabilities have the largest product wins; of equal ones the one whose last
words are longer. For searching, the known words of two and three characters inside a longer word are tokens too.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a table; a larger one is refused, since every task holds it.
MOST_WORDS = 500_000
#: Runs of these characters are cut by the table; a run of other letters and digits is a word as it stands.
CJK = "㐀-䶿一-鿿豈-﫿"


class Words:
    """A table of frequencies as the path search needs it."""

    def __init__(self, frequencies: dict[str, int]) -> None:
        self.total = math.log(max(1, sum(frequencies.values())))
        self.weight = {w: math.log(n) - self.total for w, n in frequencies.items() if n > 0 and w}
        self.longest = max(map(len, self.weight), default=1)
        # a word's first characters lead on only if some word begins with them
        self.heads = {w[:i] for w in self.weight for i in range(1, len(w))}

    def path(self, run: str) -> list[str]:
        """The words of the most probable path, from the end back: the best rest of every place is known before it is needed."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for a in range(n - 1, -1, -1):
            found = (self.weight.get(run[a], -self.total) + best[a + 1][0], a + 1)
            b = a + 1
            while b < n and run[a:b] in self.heads:
                b += 1
                if run[a:b] in self.weight:
                    found = max(found, (self.weight[run[a:b]] + best[b][0], b))
            best[a] = found
        out, a = [], 0
        while a < n:
            out.append(run[a : best[a][1]])
            a = best[a][1]
        return out

    def search_tokens(self, run: str) -> Iterator[str]:
        """Each word after the shorter known words in it."""
        for word in self.path(run):
            for size in (2, 3):
                if len(word) > size:
                    yield from (word[i : i + size] for i in range(len(word) - size + 1) if word[i : i + size] in self.weight)
            yield word


def tokens(text: str, words: Words, pieces: re.Pattern) -> list[str]:
    """NFKC and case-folded tokens in order; those without a letter or digit are dropped."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    out: list[str] = []
    for m in pieces.finditer(folded):
        out += words.search_tokens(m[0]) if m.lastgroup == "cut" else [m[0]]
    return [t for t in out if any(c.isalnum() for c in t)]


def segmented(value: Column, frequencies: DataFrame, letters: str = CJK) -> Column:
    """Tokens of a text by a table (word, n) of at most `MOST_WORDS` rows; `letters` are the characters of the runs to cut."""
    rows = frequencies.filter("word IS NOT NULL AND n > 0").groupBy("word").agg(F.sum("n").alias("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    shared = frequencies.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in rows})
    pattern = rf"(?P<cut>[{letters}]+)|[^\W{letters}]+"
    held: list[Words] = []

    def run(values: pa.Array) -> pa.Array:
        if not held:
            held.append(Words(shared.value))
        pieces = re.compile(pattern)
        return pa.array([None if v is None else tokens(v, held[0], pieces) for v in values.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(value)
