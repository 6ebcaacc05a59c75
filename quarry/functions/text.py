"""Text functions: normalisation, tokens, citations, redaction, cells and locators.

Functions on Columns stay in the JVM. Where Unicode normalisation or case folding is needed, which
Spark lacks, the `*_exact` forms are vectorised Arrow functions; the others are right for text that
is already NFKC and folds as it lower-cases.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges that count as one token each.
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u3040-\\u30ff\\uac00-\\ud7af"
PIECE = 4
# Patterns of what agent memory hides, in order, and what takes its place.
SECRETS = (
    (r"(?i)\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret|storage[_-]?key)\s*[:=]\s*\S+", "[redacted-secret]"),
    (r"(?i)(?:[A-Za-z]:[\\/][^\s]+|\\\\[^\s]+|/(?:home|users|var|etc|tmp|workspace|mnt)/[^\s]+)", "[redacted-path]"),
    (r"(?i)\b(?:select|insert|update|delete|drop|alter)\s+", "[redacted-sql] "),
    (r"(?i)\btraceback\b", "[redacted-trace]"),
)
# What looks like a citation, and what is one.
CITATION_LIKE = r"(?:\[|［|【)\s*[EeＥｅ](?:\s*\d{0,5}\s*(?:\]|］|】)?|\s*(?:\]|］|】))"
CITATION = r"\[E(?:[1-9]|1[0-2])\]"
# Fixed value: what opens a list item.
LIST_MARK = r"^(?:[-*–—]\s+|[•▪◦]\s*|(?:\d{1,4}|[A-Za-z])[.)、]\s*)"


def tokens(value: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order; the same for documents and queries."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_count(value: Column) -> Column:
    """One per CJK character, one per four characters of a word run, one per other symbol."""
    found = F.regexp_extract_all(value, F.lit(rf"[{CJK}]|[\p{{L}}\p{{N}}_]+|[^\s\p{{Z}}]"), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda a, t: a + F.ceil(F.length(t) / PIECE).cast("int"))


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def match_text(value: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return squeeze(F.lower(value))


def tight_text(value: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(value), r"\s", "")


def relaxed_text(value: Column) -> Column:
    """Also without punctuation and separators."""
    return F.regexp_replace(F.lower(value), r"[\p{P}\p{Z}\s]", "")


def source_text(value: Column) -> Column:
    """Line ends as newlines, plain spaces, no blanks at line ends, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(value, r"\r\n?", "\n")
    out = F.regexp_replace(out, " ", " ")
    out = F.regexp_replace(out, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _mapped(f: Callable[[str], str]) -> Callable[[Column], Column]:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def _fold(value: str) -> str:
    return unicodedata.normalize("NFKC", value).casefold()


def nfc(value: Column) -> Column:
    return _mapped(lambda v: unicodedata.normalize("NFC", v))(value)


def match_text_exact(value: Column) -> Column:
    return _mapped(lambda v: " ".join(_fold(v).split()))(value)


def tight_text_exact(value: Column) -> Column:
    return _mapped(lambda v: "".join(_fold(v).split()))(value)


def tokens_exact(value: Column) -> Column:
    """NFKC, case-folded tokens joined by spaces; tokens without a letter or digit are dropped."""
    import re

    return _mapped(lambda v: " ".join(t for t in re.findall(r"\w+", _fold(v)) if any(c.isalnum() for c in t)))(value)


def _window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` values, from two overlapping runs of a power of two."""
    done, h = 1, ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while done < width:
        step = min(done, width - done)
        h = (h[: len(h) - step] ^ (h[: len(h) - step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:] * np.uint64(0x94D049BB133111EB)
        done += step
    return h


def common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of tokens in both: its length is halved, as a run holds all shorter ones."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number) + 1) for t in side], np.int64) for side in (a, b))
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if len(np.intersect1d(_window_hashes(x, middle), _window_hashes(y, middle))):
            low = middle
        else:
            high = middle - 1
    return low


def longest_common_run(a: Column, b: Column) -> Column:
    """Length of the longest run of tokens that two token arrays share, over the length of the first."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([common_run(x, y or []) / len(x) if x else 0.0 for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def escape_cell(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def cell_text(display: Column, formula: Column) -> Column:
    """What a cell shows, with its formula where that isn't shown yet, escaped."""
    shown = F.coalesce(display, F.lit(""))
    extra = formula.isNotNull() & ~F.contains(shown, formula)
    return escape_cell(F.when(extra & (shown == ""), formula).when(extra, F.concat(shown, F.lit(" ("), formula, F.lit(")"))).otherwise(shown))


def row_text(role: Column, context: Column, number: Column, cells: Column) -> Column:
    """[role (context) row n] a | b, without blanks at the end."""
    head = F.concat(F.lit("["), role, F.when(context, F.lit(" context")).otherwise(F.lit("")), F.lit(" row "), number.cast("string"), F.lit("] "))
    return F.regexp_replace(F.concat(head, F.array_join(cells, " | ", "")), r"\s+$", "")


def scalar_text(kind: Column, text: Column, number: Column, flag: Column) -> Column:
    return F.when(kind == "boolean", F.upper(flag.cast("string"))).when(kind == "number", number.cast("string")).otherwise(F.coalesce(text, F.lit("")))


def column_number(label: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    letters = F.filter(F.split(F.upper(label), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_label(number: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters."""
    letter = lambda n: F.char(F.lit(65) + n)
    one = number - 1
    two = F.floor(one / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(F.pmod(two, F.lit(26)))).otherwise(""), letter(F.pmod(one, F.lit(26))))


def solid_length(value: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(value, r"\s", ""))


def citation_labels(answer: Column) -> Column:
    """Distinct strict labels in order of first use; null if anything citation-like is malformed."""
    like = F.regexp_extract_all(answer, F.lit(CITATION_LIKE), F.lit(0))
    return F.when(F.exists(like, lambda x: ~x.rlike(f"^{CITATION}$")), F.lit(None)).otherwise(F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))))


def citation_facts(answer: Column) -> Column:
    """Counts of citation-like strings by what they are."""
    like = F.regexp_extract_all(answer, F.lit(CITATION_LIKE), F.lit(0))
    fine = F.filter(like, lambda x: x.rlike(r"^\[E(0|[1-9][0-9]*)\]$"))
    number = F.transform(fine, lambda x: F.regexp_extract(x, r"([0-9]+)", 1).cast("int"))
    return F.struct(
        F.size(fine).alias("references"), F.size(F.array_distinct(fine)).alias("unique"), (F.size(like) - F.size(fine)).alias("malformed"),
        (F.size(fine) - F.size(F.array_distinct(fine))).alias("duplicates"), F.size(F.filter(number, lambda n: (n < 1) | (n > 12))).alias("out_of_range"),
    )


def safe_memory(value: Column) -> Column:
    """Secrets, paths, SQL verbs and tracebacks replaced, white space squeezed, at most 1,000 characters."""
    for pattern, by in SECRETS:
        value = F.regexp_replace(value, pattern, by)
    value = squeeze(value)
    return F.substring(F.when(value == "", F.lit("[redacted-content]")).otherwise(value), 1, 1000)


def is_list_item(value: Column) -> Column:
    return value.rlike(LIST_MARK)


def best_delimiter(sample: Column) -> Column:
    """The most frequent of comma, semicolon, tab and bar; ties go to the earlier one."""
    marks = [",", ";", "\t", "|"]
    counts = [F.length(sample) - F.length(F.replace(sample, F.lit(m), F.lit(""))) for m in marks]
    top = F.greatest(*counts)
    out = F.lit(marks[0])
    for m, c in reversed(list(zip(marks, counts, strict=True))):
        out = F.when(c == top, F.lit(m)).otherwise(out)
    return out


def stable_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
