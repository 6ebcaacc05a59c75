"""Operator 7: token counts with the whole-token shortcut.

`whole_tokens` proves offline, on the driver, which vocabulary strings encode alone as one
token. The executors match pre-tokens against that table by hash and run the merges only for
the rest, once per distinct pre-token. One pass over the texts, no shuffle.

Null and empty texts have 0 tokens and 0 bytes; special strings inside texts count as the
library counts them by default; repeated rows each give a row; an empty table gives no rows;
columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _bpe, _store
from quarry.llm import _bytes as B
from quarry.session import spread


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; path names the tokenizer's file on every machine."""
    _store.ship(docs.sparkSession)
    whole = _bpe.whole_tokens(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _bpe.Coder(path, ids=False, known=whole)
        for batch in batches:
            n, _ = coder.encode(batch.column(1))
            _, off = B.flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return rows.mapInArrow(_store.lean(count), f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_token_counts": query}
ORACLES: dict[str, str] = {}
