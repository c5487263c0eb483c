"""Line dedup over levelled sorted runs of line hashes (operator 1).

A run is a table (h1, h2, n): the 128-bit hash of a line's key and in how many documents it was
seen, one row per key, bucketed and sorted by the hash. All runs have the same buckets, so merging
runs and joining with them move nothing: each task merges one bucket of them. Each batch of documents
is grouped to one row per key, merge-joined with the runs, loses the keys that these together have in
enough documents already (their fate is settled), and is added as a run of level 0. When a level has `fanout` runs they are
compacted into one run of the next level. Documents then lose the lines whose key all runs together
have in at least `min_docs` documents.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. A document is a
row: repeated rows count each. Defined results: null and empty texts are one empty line; lines with
an empty key are never dropped; a text whose lines all go becomes the empty text; rows of null or
repeated id are handled like any other; an empty table gives an empty result; other columns
stay, but those named n_lines, n_dropped or kept_text are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orolith.llm import common

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Lower-casing touches A-Z alone; for a line of ASCII the faster lower() does the same."""
    ascii_only = F.length(line) == F.octet_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(BLANK))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineRuns:
    """The levelled runs; `levels[i]` lists the run tables of level i."""

    spark: SparkSession
    min_docs: int = 10
    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)
    made: list[tuple[str, str]] = field(default_factory=list)  # name and path of every run

    def __post_init__(self):
        # as many buckets as a shuffle has partitions, so that a grouped batch meets them as it is
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, fresh: DataFrame) -> DataFrame:
        """The rows (h1, h2, n) whose key the runs so far don't have in enough documents."""
        known = F.lit(0).cast("long")
        for k, run in enumerate(self.runs()):
            fresh = fresh.join(run.withColumnRenamed("n", f"n{k}"), ["h1", "h2"], "left")
            known = known + F.coalesce(f"n{k}", F.lit(0))
        return fresh.where(known < self.min_docs).select("h1", "h2", "n")

    def add(self, seen: DataFrame) -> None:
        """Add a batch, as rows (h1, h2) for each document and key in it."""
        self._put(self.unsettled(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"))), 0)

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = common.table_path(self.spark, f"run-{level}")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        rows.select("h1", "h2", "n").write.option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.made.append((name, path))
        self.levels[level].append(self.spark.table(name))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = merge(self.levels[level]), []
            self._put(merged, level + 1)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in at least min_docs documents over all runs."""
        return merge(self.runs()).where(F.col("n") >= self.min_docs).select("h1", "h2")

    def drop(self) -> None:
        """Remove all runs."""
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.removed(self.spark, path)
        self.levels, self.made = [], []


def merge(runs: list[DataFrame]) -> DataFrame:
    """One row per key of the runs: a full outer merge join, which for two runs of the same buckets
    needs no shuffle. (Grouping a union of them would be shorter, but Spark 4.1.2 takes a union of
    bucketed tables for bucketed without keeping its buckets together, and gives keys twice.)"""
    out = runs[0]
    for run in runs[1:]:
        both = out.join(run.withColumnRenamed("n", "more"), ["h1", "h2"], "full_outer")
        out = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
    return out


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, batches: int | None = None, fanout: int = 2, by_text: bool = False) -> DataFrame:
    """docs with three more columns: n_lines, n_dropped (both long) and kept_text.

    With `by_text` all rows of one text count as one document. Without `batches` there are as many as
    the number of documents has binary digits beyond 14: few however many documents there are.

    The text is read once for hashing and once for the result; between them only hashes move:
    16 bytes a line, each batch in files of its own. The frequent keys' skewed lines meet the small
    run side in a join that Spark may split; grouping is per document and on line numbers only.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    if batches is None:
        batches = max(1, (docs.count() >> 14).bit_length())
    k1, k2 = common.row_keys(text)
    key = F.transform(lines_of(text), lambda x: F.struct(line_key(x).alias("k")))
    hashed = F.transform(key, lambda x: F.struct(F.xxhash64(x.k).alias("h1"), F.xxhash64(F.lit(7), x.k).alias("h2"), (x.k != "").alias("some")))
    lines = docs.select(k1.alias("k1"), k2.alias("k2"), hashed.alias("lines"))
    lines = lines.select("k1", "k2", F.transform("lines", lambda x: F.when(x.some, F.struct(x.h1.alias("h1"), x.h2.alias("h2")))).alias("lines"), F.pmod("k2", F.lit(batches)).cast("int").alias("part"))
    if by_text:
        lines = lines.dropDuplicates(["k1", "k2"])
    path = common.table_path(spark, "line-hashes")
    lines.write.partitionBy("part").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    index = LineRuns(spark, min_docs, fanout)
    for part in range(batches):
        seen = lines.where(F.col("part") == part).select(F.explode(F.array_distinct("lines")).alias("h")).where("h IS NOT NULL")
        index.add(seen.select("h.h1", "h.h2"))
    at = lines.select("k1", "k2", F.posexplode("lines").alias("i", "h")).where("h IS NOT NULL").select("k1", "k2", "i", "h.h1", "h.h2")
    frequent = common.stored(index.frequent(), "frequent-lines")  # as a plain table, so that Spark may split a key's lines in the join
    index.drop()
    hit = at.join(common.sized(frequent), ["h1", "h2"], "left_semi").select("k1", "k2", "i").distinct()
    dropped = common.stored(hit.groupBy("k1", "k2").agg(F.collect_list("i").alias("__dropped")), "dropped-lines")
    common.removed(spark, path)

    # Only the text moves in the join; its lines are made behind it, once, by an explode of one row.
    named = docs.withColumns({"__k1": k1, "__k2": k2}).join(common.sized(dropped.withColumnsRenamed({"k1": "__k1", "k2": "__k2"})), ["__k1", "__k2"], "left")
    named = named.select("*", F.explode(F.array(lines_of(text))).alias("__lines"))
    every, gone = F.col("__lines"), F.coalesce("__dropped", F.expr("cast(array() AS array<int>)"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    kept = F.when(F.size(gone) == 0, F.concat_ws("\n", every)).otherwise(F.concat_ws("\n", F.transform(numbers, lambda i: F.get(every, i))))
    return named.select(*common.others(docs, "n_lines", "n_dropped", "kept_text"), F.size(every).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), numbered AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM lines
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM numbered
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE f.k IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k)
GROUP BY doc_id
"""
