"""Evidence context: anchors and their neighbours under token and segment budgets."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import count_tokens, token_spans


def candidates(anchors: DataFrame, neighbours: DataFrame) -> DataFrame:
    """query_id, chunk_id, role, anchor_rank, priority: all anchors by rank, then each anchor's previous and next.

    anchors: query_id, chunk_id, rank; neighbours: chunk_id, previous, next. A chunk that several want
    goes to the first of them.
    """
    mine = anchors.select("query_id", "chunk_id", F.lit("anchor").alias("role"), F.col("rank").alias("anchor_rank"), F.lit(0).alias("tier"), F.lit(0).alias("side"))
    near = anchors.join(neighbours, "chunk_id")
    sides = F.explode(F.array(F.struct(F.col("previous").alias("c"), F.lit("previous").alias("role"), F.lit(0).alias("side")), F.struct(F.col("next").alias("c"), F.lit("next").alias("role"), F.lit(1).alias("side"))))
    near = near.select("query_id", F.col("rank").alias("anchor_rank"), sides.alias("x")).select("query_id", F.col("x.c").alias("chunk_id"), "x.role", "anchor_rank", F.lit(1).alias("tier"), "x.side").filter("chunk_id IS NOT NULL")
    rows = mine.unionByName(near)
    order = [F.col("tier"), F.col("anchor_rank"), F.col("side")]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).filter("r = 1")
    return rows.withColumn("priority", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "chunk_id", "role", "anchor_rank", "priority", "side")


def trim(body: str, overlap: int, previous: str | None) -> str | None:
    """The body without the tokens it shares with a chosen predecessor; None if they are not its end."""
    if previous is None or not overlap:
        return body.strip()
    spans = token_spans(body)
    if overlap > len(spans):
        return None
    end = spans[overlap - 1][1]
    return body[end:].strip() if previous.rstrip().endswith(body[:end].strip()) else None


def trim_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """key, chunk_index, text: every chunk without what it shares with the one before; null if that isn't its end.

    chunks: key, chunk_index, body, overlap_tokens, all of them chosen. A document's chunks lie in one task.
    """

    def run(bodies: pa.Array, overlaps: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array([trim(b, n or 0, p) for b, n, p in zip(bodies.to_pylist(), overlaps.to_pylist(), before.to_pylist(), strict=True)], pa.string())

    before = F.lag("body").over(Window.partitionBy(key).orderBy("chunk_index"))
    rows = chunks.select(key, "chunk_index", "body", "overlap_tokens", before.alias("_before"))
    return rows.select(key, "chunk_index", F.arrow_udf(run, "string")("body", "overlap_tokens", "_before").alias("text"))


def trim_table(body: Column) -> Column:
    """A table chunk without the rows it repeats as context; a row is a line, and its mark says what it is."""
    return F.array_join(F.filter(F.split(body, "\n"), lambda line: ~line.rlike(r"^\[(?:header|data) context row \d+\]")), "\n")


def _choose(query, group: pd.DataFrame, most_tokens: int, most_segments: int) -> pd.DataFrame:
    """Admit in order of priority; whoever breaks a budget or repeats a text is left out and costs nothing.

    A row changes its own text and that of the chunk after it, which now has a predecessor; no other.
    """
    chosen: dict[tuple, tuple] = {}  # (document, chunk index) -> row, text, tokens
    raw: set[str] = set()
    total = 0

    def shown(row, before) -> tuple | None:
        text = trim(row.body, int(row.overlap_tokens), before.body if before is not None else None)
        return (row, text, count_tokens(text)) if text else None

    for row in group.itertuples():
        if row.body in raw or len(chosen) == most_segments:
            continue
        place, following = (row.document_id, row.chunk_index), (row.document_id, row.chunk_index + 1)
        before = chosen.get((row.document_id, row.chunk_index - 1))
        changed = {place: shown(row, before[0] if before else None)}
        if following in chosen:
            changed[following] = shown(chosen[following][0], row)
        texts = {c[1] for at, c in chosen.items() if at not in changed}
        new = [c[1] for c in changed.values() if c is not None]
        cost = total + sum(c[2] for c in changed.values() if c is not None) - sum(chosen[at][2] for at in changed if at in chosen)
        if place in chosen or None in changed.values() or len(set(new)) < len(new) or texts & set(new) or cost > most_tokens:
            continue
        chosen |= changed
        total = cost
        raw.add(row.body)
    out = [(query, r.chunk_id, r.role, int(r.anchor_rank), text, n) for r, text, n in chosen.values()]
    rank = {"previous": 0, "anchor": 1, "next": 2}
    out.sort(key=lambda x: (x[3], rank[x[2]]))
    return pd.DataFrame([(*x, i) for i, x in enumerate(out, 1)], columns=["query_id", "chunk_id", "role", "anchor_rank", "text", "tokens", "position"])


def select_context(rows: DataFrame, most_tokens: int = 4000, most_segments: int = 12) -> DataFrame:
    """Chosen segments in reading order. rows: candidates joined to body, document_id, chunk_index, overlap_tokens.

    A query's candidates are at most three per anchor, so a group is small whatever the corpus.
    """
    schema = "query_id long, chunk_id long, role string, anchor_rank int, text string, tokens int, position int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _choose(pdf["query_id"].iloc[0], pdf.sort_values("priority"), most_tokens, most_segments)

    return rows.groupBy("query_id").applyInPandas(run, schema)
