"""Operator 9: line dedup by a deletion-neighbourhood join, for one edit. Built-in functions only.

A line is removed if an equal line or, for lines of at least `least` characters, a line within one
inserted, deleted or replaced character of it stands earlier in the input (smaller key, or the same
document and an earlier line). Lines are judged on the input, not on what is left.

1. Equal lines meet by hash and keep the first place (combined before the shuffle).
2. One edit leaves the first or the last half of the shorter line untouched, so distinct lines are
   keyed by their halves; only lines that share a half with another one go on. Of those the texts are
   fetched from their first places, and the same is done again with all but one of `PIECES` pieces of the
   line. These filters lose nothing, and what passes is a small part of a corpus.
3. Those emit every deletion variant as a hashed key. Equal variants deleted at the same place differ
   by one replaced character; a variant that equals a whole line differs by one inserted one. Each key
   keeps only its earliest line, so no pairs are emitted, and what is found is verified on the lines: an
   edit at that place, and no other.

A variant of fewer than `LONG` characters is built and hashed; longer ones are never built: their hash
is a sum over characters and places, so running sums from both ends give all variants of a line in time
in proportion to its length.

Lines are split at newlines; lines without anything but spaces are never removed. Null and empty
texts have no lines to remove; rows that share a key share their result; null keys come first and
are one document; an empty table gives no rows; extra columns are ignored. Equality of lines is that
of 64-bit hashes and lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _store

#: Candidate hashes are broadcast up to this number of rows (16 bytes each); beyond it they are joined by shuffle.
MOST_BROADCAST = 200_000
PIECES = 8
LONG = 256


def _halves(line: Column) -> Column:
    """Hashes of the halves that a line shares with a line one edit away, whichever of the two is longer."""
    n = F.length(line)
    keys = []
    for h in (F.floor(n / 2), F.floor((n - 1) / 2)):
        h = h.cast("int")
        keys += [F.xxhash64(F.lit(1), h, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit(2), h, F.substring(line, n - h + 1, h))]
    return F.array_distinct(F.array(*keys))


def _but_a_piece(line: Column) -> Column:
    """Hashes of the line without each of its pieces, cut as if it were the shorter or the longer one of a pair."""
    n = F.length(line)
    keys = []
    for m in (n, n - 1):
        for j in range(PIECES):
            before = F.floor(m * j / PIECES).cast("int")
            after = (m - F.floor(m * (j + 1) / PIECES)).cast("int")
            # substring from 0 on would count 0 as 1, and one of no characters from the end is empty
            tail = F.when(after > 0, F.substring(line, n - after + 1, after)).otherwise("")
            keys.append(F.xxhash64(F.lit(j), m, F.substring(line, F.lit(1), before), tail))
    return F.array(*keys)


def _variants(chosen: DataFrame) -> DataFrame:
    """h, n, first, p, v of every line (h, n, first, line): the hash v of the line without its character p; p = 0: of the whole line."""
    short = F.when(F.col("n") <= LONG, F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: F.struct(p.alias("p"), F.xxhash64(F.concat(F.substring(F.col("line"), F.lit(1), p - 1), F.substring(F.col("line"), p + 1, F.col("n")))).alias("v"))))
    whole = F.when(F.col("n") < LONG, F.array(F.struct(F.lit(0).alias("p"), F.xxhash64("line").alias("v"))))
    some = chosen.filter(F.col("n") <= LONG).select("h", "n", "first", F.explode(F.concat(F.coalesce(whole, F.array().cast("array<struct<p:int,v:bigint>>")), short)).alias("x")).select("h", "n", "first", "x.p", "x.v")
    # longer ones: characters as rows; a character's share in a hash depends on it and its place, which is one less behind the gap
    chars = chosen.filter(F.col("n") >= LONG).select("h", "n", "first", F.posexplode(F.split("line", "")).alias("i", "c")).withColumn("p", F.col("i") + 1)
    run = Window.partitionBy("h", "n").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = Window.partitionBy("h", "n")
    for seed in (1, 2):
        own = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "c", "p"), 24)
        moved = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "c", F.col("p") - 1), 24)
        ahead, behind = F.sum(own).over(run) - own, F.sum(moved).over(line) - F.sum(moved).over(run)
        chars = chars.withColumns({f"v{seed}": ahead + behind, f"w{seed}": ahead + own})
    long = chars.filter(F.col("n") > LONG).select("h", "n", "first", F.col("p").cast("int").alias("p"), F.xxhash64("v1", "v2").alias("v"))
    full = chars.filter("p = n").select("h", "n", "first", F.lit(0).alias("p"), F.xxhash64("w1", "w2").alias("v"))
    return some.unionByName(long).unionByName(full)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, i, line, h, n of every line with anything but spaces."""
    rows = docs.select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("i", "line"))
    return rows.filter(F.trim("line") != "").withColumn("h", F.xxhash64("line")).withColumn("n", F.length("line"))


def repeated_lines(spark: SparkSession, docs: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, i of every removed line (i from 0)."""
    lines = _lines(docs, key, text)
    long = F.col("n") >= least
    place = F.struct("k", "i")
    distinct = lines.groupBy("h", "n").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.min(F.when(long, _halves(F.col("line")))).alias("halves"))
    distinct = _store.cut(spark, distinct)
    halves = distinct.filter("halves IS NOT NULL").select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("half")
    passing = halves.join(shared, "half", "left_semi").select("h").distinct()
    passing = _store.cut(spark, distinct.join(passing, "h", "left_semi").filter("halves IS NOT NULL").select("h", "n", "first"))
    # the lines themselves from their first places, which no two lines share, so no key is hot
    places = passing.groupBy(F.col("first.k").alias("k")).agg(F.collect_list(F.struct(F.col("first.i").alias("i"), "h", "n")).alias("wanted"))
    some = F.broadcast(places) if passing.count() <= MOST_BROADCAST else places
    texts = docs.select(F.col(key).alias("dk"), F.split(F.col(text).cast("string"), "\n").alias("lines"))
    found = texts.join(some, F.col("dk").eqNullSafe(F.col("k"))).select("k", "lines", F.explode("wanted").alias("x")).select("k", "x.*", F.get("lines", F.col("x.i")).alias("line"))
    # rows may share a key: the hash tells whose line it is
    found = found.filter((F.xxhash64("line") == F.col("h")) & (F.length("line") == F.col("n")))
    chosen = _store.cut(spark, found.select("h", "n", F.struct("k", "i").alias("first"), "line").dropDuplicates(["h", "n"]))
    pieces = chosen.select("h", F.explode(_but_a_piece(F.col("line"))).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("piece")
    passing = pieces.join(shared, "piece", "left_semi").select("h").distinct()
    chosen = _store.cut(spark, chosen.join(passing, "h", "left_semi"))
    variants = _store.cut(spark, _variants(chosen))
    me = F.struct("first", "h", "n")
    # replaced: the earliest line with the same variant at the same place
    same = Window.partitionBy("v", "p", "n")
    replaced = variants.filter("p > 0").withColumn("other", F.min(me).over(same)).filter("other.h <> h").select("h", "n", "first", "other", "p")
    # inserted or deleted: the variant is the other line, which may come before or after
    whole = variants.filter("p = 0").select("v", F.col("h").alias("wh"), F.col("n").alias("wn"), F.col("first").alias("wf"))
    met = variants.filter("p > 0").join(whole, "v").filter("wn = n - 1")
    shorter = met.select("h", "n", "first", F.struct(F.col("wf").alias("first"), F.col("wh").alias("h"), F.col("wn").alias("n")).alias("other"), "p")
    longer = met.select(F.col("wh").alias("h"), F.col("wn").alias("n"), F.col("wf").alias("first"), me.alias("other"), "p")
    found = replaced.unionByName(shorter).unionByName(longer).filter("other.first < first").groupBy("h", "n").agg(F.min(F.struct("other", "p")).alias("x")).select("h", "n", "x.*")
    words = chosen.select("h", "n", "line")
    mine = found.join(words, ["h", "n"])
    theirs = words.select(F.col("h").alias("oh"), F.col("n").alias("on"), F.col("line").alias("other_line"))
    near = mine.join(theirs, (F.col("other.h") == F.col("oh")) & (F.col("other.n") == F.col("on")))
    less = lambda x: F.concat(F.substring(x, F.lit(1), F.col("p") - 1), F.substring(x, F.col("p") + 1, F.length(x)))
    # linear, where a general edit distance is not: without the character at p, of both or of the longer one, they are equal
    one, two = F.col("line"), F.col("other_line")
    equal = F.when(F.col("n") == F.col("on"), less(one) == less(two)).when(F.col("n") > F.col("on"), less(one) == two).otherwise(one == less(two))
    near = near.filter(equal).select("h", "n", F.lit(True).alias("near"))
    judged = distinct.select("h", "n", "first", "copies").join(near, ["h", "n"], "left").filter("copies > 1 OR near")
    met = _store.join_skewed(spark, lines.select("k", "i", "h", "n"), judged, ["h", "n"], "copies").filter("first IS NOT NULL")
    removed = met.filter(F.coalesce("near", F.lit(False)) | ~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("i") == F.col("first.i"))))
    return removed.select("k", "i").distinct()


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """key, n_lines, n_removed, removed (places from 0, in order) and, with texts, the text of the kept lines."""
    gone = repeated_lines(spark, docs, least, key, text).groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("removed"))
    lines = F.split(F.col(text).cast("string"), "\n")
    rows = docs.select(F.col(key).alias("k"), F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), *([F.col(text).alias("t")] if texts else []))
    full = rows.alias("r").join(gone.alias("g"), F.col("r.k").eqNullSafe(F.col("g.k")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = [F.col("r.k").alias(key), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed")]
    if texts:
        kept = F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains(removed, i))
        out.append(F.array_join(kept, "\n").alias("kept"))
    return full.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return rows.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


SQL = """
WITH lines AS (
  SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
), firsts AS (
  SELECT line, length(line) AS n, min({'k': k, 'i': i}) AS first FROM lines WHERE trim(line, ' ') <> '' GROUP BY line
), variants AS (
  SELECT line, n, first, p, hash(substr(line, 1, p - 1) || substr(line, p + 1)) AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM firsts WHERE n >= 20)
), near AS (
  SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY v, p, n) AS least FROM variants) WHERE least < first
  UNION SELECT a.line FROM variants a JOIN firsts b ON a.v = hash(b.line) AND b.n = a.n - 1 AND b.n >= 20 WHERE b.first < a.first
  UNION SELECT b.line FROM variants a JOIN firsts b ON a.v = hash(b.line) AND b.n = a.n - 1 AND b.n >= 20 WHERE a.first < b.first
), removed AS (
  SELECT l.k, count(*) AS n_removed, string_agg(CAST(l.i AS VARCHAR), ',' ORDER BY l.i) AS removed_lines
  FROM lines l JOIN firsts f ON l.line = f.line WHERE l.k <> f.first.k OR l.i <> f.first.i OR l.line IN (SELECT line FROM near) GROUP BY l.k
)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  coalesce(r.n_removed, 0) AS n_removed, coalesce(r.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN removed r ON r.k = d.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_line_dedup": query}
ORACLES: dict[str, str] = {"op9_line_dedup": SQL}
