"""Line deduplication by overlapping windows of three lines (operator 8).

Every three consecutive lines of a document are a window.  A window that occurs more
than once, anywhere, keeps its first occurrence (smallest doc_id, then smallest place);
every line that a later occurrence covers is removed, so overlapping later windows merge
into one removed stretch.  A line that is removed has an earlier copy, and the earliest
copy of a line is never removed, so no line of text disappears from the corpus.

Everything is DataFrame work.  Windows are 128-bit hashes; the first occurrence is a
min() with map-side combine, so a window with a third of all occurrences does no harm;
only windows that repeat are joined back, on the hash, where AQE can split a hot one.
Removed places are gathered per document and joined to the texts by document.

Defined results: null and empty texts have no windows and come back as they are; texts
of fewer than three lines are never changed; rows that repeat both id and text are one
document and each get its result; a text whose lines are all removed becomes empty.
Extra columns are kept as they are; the operator's own names start with an underscore.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import column_function, read_table, text_key

WINDOW_LINES = 3


def _hash128(value):
    return F.struct(F.xxhash64(value, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), value).alias("b"))


def removed_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES) -> DataFrame:
    """(_id, _key, _gone): for documents that lose lines, the sorted places (from 0) of those lines."""
    lines = F.split(F.col(text_col), "\n", -1)
    rows = docs.where(F.col(text_col).contains("\n")).select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), lines.alias("l")).where(F.size("l") >= window)
    windows = F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda i: F.slice(F.col("l"), i + 1, window))
    occurrences = rows.select("_id", "_key", F.posexplode(windows).alias("_pos", "w")).select("_id", "_key", "_pos", _hash128(F.col("w")).alias("h"))
    place = F.struct(F.col("_id").isNull().alias("n"), "_id", "_key", "_pos")
    # A row that repeats id and text repeats places too; they count as one occurrence.
    firsts = occurrences.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    later = occurrences.join(firsts, "h").where(place != F.col("first")).select("_id", "_key", "_pos")
    spots = F.flatten(F.transform(F.collect_set("_pos"), lambda p: F.sequence(p, p + window - 1)))
    return later.groupBy("_id", "_key").agg(F.array_sort(F.array_distinct(spots)).alias("_gone"))


@column_function(pa.string())
def cut_lines(text: pa.Array, places: pa.Array) -> pa.Array:
    """The text without the lines at the given sorted places; null where there are none."""
    out = []
    for t, gone in zip(text, places):
        if not gone.is_valid:
            out.append(None)
            continue
        lines, kept, at = t.as_py().split("\n"), [], 0
        for p in gone.as_py():
            kept += lines[at:p]
            at = p + 1
        out.append("\n".join(kept + lines[at:]))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES) -> DataFrame:
    """The documents with repeated stretches cut out, and ``_n_lines``, ``_n_removed``."""
    gone = removed_places(docs, id_col, text_col, window).withColumnRenamed("_key", "_gone_key")
    own = docs.withColumn("_key", text_key(text_col))
    joined = own.join(gone, own[id_col].eqNullSafe(gone["_id"]) & (own["_key"] == gone["_gone_key"]), "left").drop("_id", "_key", "_gone_key")
    text = F.col(text_col)
    n_lines = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    joined = joined.withColumns({"_n_lines": n_lines.cast("long"), "_n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")})
    changed = cut_lines(F.when(F.col("_gone").isNotNull(), text), F.col("_gone"))
    return joined.withColumn(text_col, F.coalesce(changed, text)).drop("_gone")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
