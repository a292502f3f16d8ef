"""Audit of how five filters interact, over a stream with retractions (operator 11).

The documents are read as a file stream that processes everything available in micro-batches.

1. Each document gets a mask: a bit for each filter it fails, by its own text.  The last
   filter, "identical to the text of a smaller id", depends on all others.
2. All rows of a batch are counted by (part, mask) as if they had a smaller copy.
3. Keyed state corrects that for the holders of the smallest ids: for each text (a 128-bit hash)
   the smallest id so far, with the parts and masks of the rows that hold it.  When a smaller
   id arrives, the earlier holder's correction is retracted, and the new one's is made.
4. State and counters of a batch are written under its number, in the shared folder, and a
   batch reads the state of smaller numbers only.  So a batch that runs again after a failure
   replaces what it wrote, and a later call with the same folder goes on from there.
5. All orders of the filters follow from the summed counters alone, 32 masks for each part.

Copies: the smallest id of a text is a min() with map-side combine, and its holders are
looked up by (text, id), so a text that a third of the documents repeat weighs down no task.
A batch reads the earlier state, some 60 bytes for each text, so few large batches are best.
Labels are reduced to one row for each id and joined by id in each batch.

State is a table, not Spark's keyed Python state: that ran a Python call for each text, and cost
754 of 933 CPU seconds a GB.

Defined results: a null text is an empty one, a null part an empty string; rows that repeat
an id and its text are all counted, and none of them is a smaller copy of another; a row
without an id is no copy, makes none and has no label; ids are whole numbers or texts, compared as such; a
repeated label counts if any of its rows is 1; an empty table has no parts and no rows.  Only
the named columns are read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import discard, read_table, shared_dir, text_key

#: The filters of the contract, by letter; each one's bit in a mask is its place.
FILTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}
COPY = BIT["E"]
GOOD, TOXIC = 32, 64
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
MARKS = "[#$%&*|]"
#: Micro-batches of one call over a whole table.
BATCHES = 4

COUNTERS = "part string, code int, n long"


def own_mask(text: Column, words: Column) -> Column:
    """The bits that a text decides by itself."""
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = {"A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, "C": 100 * capitals > CAPITAL_PERCENT * F.char_length(text), "D": text.rlike(MARKS)}
    return sum((F.when(failed, BIT[letter]).otherwise(0) for letter, failed in fails.items()), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_key, _id, _part, _code) of every document: its text's hash, and its mask with the labels' bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.select(text_key("_text").alias("_key"), "_id", "_part", own_mask(F.col("_text"), F.col("_words")).alias("_mask"))
    bit = lambda name, value: F.max(F.when(F.col(name) == 1, value).otherwise(0))
    bits = labels.groupBy(F.col("doc_id").alias("_label_id")).agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("_bits"))
    joined = rows.join(bits, rows["_id"] == bits["_label_id"], "left")
    return joined.select("_key", "_id", "_part", (F.col("_mask") + F.coalesce("_bits", F.lit(0))).cast("int").alias("_code"))


def holders(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """(_key, _id, _part, _code, _n, _fresh, _sign) of the texts in ``rows``: with sign 1 the rows,
    earlier ones included, that hold the smallest id now; with sign -1 the earlier ones that
    held it before.  What does not change is there with both signs."""
    fresh = rows.where("_id is not null").select("_key", "_id", "_part", "_code", F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_fresh"))
    both = fresh.unionByName(earlier.withColumn("_fresh", F.lit(False)))
    least = both.groupBy("_key").agg(F.min("_id").alias("_now"), F.min(F.when(~F.col("_fresh"), F.col("_id"))).alias("_before"), F.max("_fresh").alias("_asked")).where("_asked")
    signs = F.explode(F.array(F.struct(F.col("_now").alias("_id"), F.lit(1).alias("_sign")), F.struct(F.col("_before").alias("_id"), F.lit(-1).alias("_sign"))))
    wanted = least.select("_key", signs.alias("_s")).select("_key", "_s.*").where("_id is not null")
    found = both.join(wanted, ["_key", "_id"]).where("_sign = 1 OR NOT _fresh")
    return found.groupBy("_key", "_id", "_part", "_code", "_fresh", "_sign").agg(F.sum("_n").alias("_n"))


def counter_changes(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(part, code, n): what a batch changes.  Its rows count as copies, unless they have no
    id; holders are taken out from under that and counted without."""
    copy = F.col("_code").bitwiseOR(COPY)
    every = rows.select("_part", F.when(F.col("_id").isNull(), F.col("_code")).otherwise(copy).alias("_code"), F.lit(1).cast("long").alias("_n"))
    n = F.col("_n") * F.col("_sign")
    moved = held.select("_part", F.explode(F.array(F.struct(F.col("_code").alias("_to"), n.alias("_n")), F.struct(copy.alias("_to"), (-n).alias("_n")))).alias("_m")).select("_part", F.col("_m._to").alias("_code"), F.col("_m._n").alias("_n"))
    return every.unionByName(moved).groupBy(F.col("_part").alias("part"), F.col("_code").alias("code")).agg(F.sum("_n").alias("n"))


def audit_batch(labels: DataFrame, folder: str, id_col: str, text_col: str, part_col: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: state and counters of one batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = f"{folder}/{name}/batch={number}"
            df.write.mode("overwrite").parquet(path)
            table = spark.read.schema(df.schema).parquet(path)
            table.stored_at = path
            return table

        rows = kept(marked(batch, labels, id_col, text_col, part_col), "rows")
        columns = ["_key", "_id", "_part", "_code", "_n"]
        shape = rows.select("*", F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_fresh"), F.lit(1).alias("_sign")).schema
        written = [f"{folder}/state/batch={k}" for k in range(number)]
        state = spark.read.schema(shape).parquet(*written) if written else spark.createDataFrame([], shape)
        held = kept(holders(rows, state.where("_fresh AND _sign = 1").select(*columns)), "state")
        kept(counter_changes(rows, held), "counters")
        discard(rows)

    return run


def count_available(docs: DataFrame, labels: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Process what a streaming DataFrame of documents has, then return the counters (part, code, n) of
    everything that was ever processed with this ``folder``."""
    spark = docs.sparkSession
    audit = audit_batch(labels, folder, id_col, text_col, part_col)
    docs.select(id_col, text_col, part_col).writeStream.foreachBatch(audit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counters")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], COUNTERS)
    changed = spark.read.schema(COUNTERS + ", batch long").parquet(f"{folder}/counters")
    return changed.groupBy("part", "code").agg(F.sum("n").alias("n")).where("n <> 0")


def passing(counts: Column) -> Column:
    """Counts by mask -> for each set of filters, the count of what fails none of them."""
    return F.array(*(sum((F.get(counts, F.lit(m)) for m in range(1 << len(FILTERS)) if not m & s), F.lit(0)) for s in range(1 << len(FILTERS))))


def interactions(counters: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counters alone."""
    sets = 1 << len(FILTERS)
    mask = F.col("code").bitwiseAND(sets - 1)
    counted = lambda which: F.array(*(F.sum(F.when((mask == m) & which, F.col("n")).otherwise(0)) for m in range(sets)))
    has = lambda bit: F.col("code").bitwiseAND(bit) != 0
    parts = counters.groupBy("part").agg(counted(F.lit(True)).alias("_n"), counted(has(GOOD)).alias("_g"), counted(has(TOXIC)).alias("_t"))
    parts = parts.select("part", "_n", passing(F.col("_n")).alias("_np"), passing(F.col("_g")).alias("_gp"), passing(F.col("_t")).alias("_tp"))
    # Of the orders, so many have just these filters before a filter: |before|! * |after|!.
    orders_with = lambda before: math.factorial(before.bit_count()) * math.factorial(len(FILTERS) - 1 - before.bit_count())
    at = lambda array, place: F.get(array, place if isinstance(place, Column) else F.lit(place))
    value = {letter: sum((orders_with(s) * (at("_np", s) - at("_np", s | bit)) for s in range(sets) if not s & bit), F.lit(0)) for letter, bit in BIT.items()}
    parts = parts.withColumn("_value", F.array(*(value[letter] for letter in FILTERS)))
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.contains(earlier, F.lit(letter)), bit).otherwise(0) for letter, bit in BIT.items()), F.lit(0))
    rows = rows.withColumns({"_place": place, "_before": before}).withColumn("_bit", F.expr("shiftleft(1, _place)"))
    rows = rows.withColumn("_after", F.col("_before").bitwiseOR(F.col("_bit")))
    lost = lambda array: at(array, F.col("_before")) - at(array, F.col("_after"))
    fails = at("_np", 0) - at("_np", F.col("_bit"))
    out = {
        "kept": at("_np", F.col("_after")), "removed": lost("_np"), "redundant": fails - lost("_np"), "unique_fails": at("_n", F.col("_bit")), "good_lost": lost("_gp"), "toxic_lost": lost("_tp"),
        "shapley": at("_value", F.col("_place")),
    }
    return rows.select("part", "filter_order", "step", *(c.cast("long").alias(k) for k, c in out.items()))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "documents")
    files = max(1, -(-len(table.inputFiles()) // BATCHES))
    # A pattern, as a table that is one file cannot be the base folder of a stream.
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/documents.[p]arquet")
    return interactions(count_available(docs, read_table(spark, sf_dir, "labels"), f"{shared_dir(spark)}/filter-audit-{uuid.uuid4().hex}"))
