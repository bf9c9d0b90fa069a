"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ...; together they get as many words as all texts hold. A
target stops at ``epochs`` times its source's size and the excess is shared again by weight. A source takes each text
as often as its size goes whole into the target, and once more each text whose hash lies under a threshold. The
threshold comes from nested histograms: words by (source, first hash digits), then only the bucket in which the budget
runs out is split by its next digits, twice. No text is ever sorted, and a source of any size is pre-aggregated in
every task.

Defined cases: a null text has size 0; null is a source of its own, after all others; a null id hashes like an empty
string; rows that share an id share its hash and are taken alike; ties of the 36 hash bits are taken or left together,
whichever comes nearer to the target; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
WEIGHTS = 3
DIGITS = (3, 6, 9)


def hash_digits(id_col: Column) -> Column:
    """36 bits of a hash that only the id decides, as hex digits: their order is the order of the numbers."""
    return F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, DIGITS[-1])


def source_targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> target: the weighted share, capped at epochs times the size, the rest reshared.

    Sources that hit their cap are those of the smallest size for their weight, so one pass in that order settles all.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    cap, everything = F.col("source_size") * epochs, W.orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    earlier, whole = everything.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shared = ranked.withColumn("ratio", F.col("source_size") / F.col("weight")).select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("weights_left"),
    )
    capped = shared.withColumn("capped", cap.cast("double") * F.col("weights_left") < F.col("left").cast("double") * F.col("weight"))
    rest = capped.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(whole), F.lit(0))).alias("budget"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole).alias("weights"),
    )
    share = (F.col("budget") * F.col("weight")).cast("double") / F.col("weights")
    return rest.select("source", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


def _within(rows: DataFrame, bounds: DataFrame, *columns: str) -> DataFrame:
    """Rows with what bounds has for their source. bounds is a written table, so the planner knows its size and joins
    by broadcast below its threshold, else by a shuffle whose skewed partitions are split."""
    b = bounds.select(F.col("source").alias("_source"), *columns)
    return rows.join(b, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(base: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, whole (times every text is taken), last (largest hash taken once more)."""
    first = storage.materialize(base.groupBy("source", F.substring("h", 1, DIGITS[0]).alias("bucket")).agg(F.sum("size").alias("words")), "mix-hist")
    targets = source_targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    state = targets.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    state = storage.materialize(state.select("*", F.lit(0).cast("long").alias("below"), F.lit("").alias("edge")), "mix-state")
    running = W.partitionBy("source").orderBy("bucket")
    for level, digits in enumerate(DIGITS):
        if level:
            inside = _within(base, state, "edge").where(F.substring("h", 1, DIGITS[level - 1]) == F.col("edge"))
            hist = inside.groupBy("source", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
        else:
            hist = first
        upto = _within(hist, state, "goal", "below").withColumn("upto", F.col("below") + F.sum("words").over(running))
        before = F.col("upto") - F.col("words")
        if digits != DIGITS[-1]:
            over = upto.where(F.col("upto") > F.col("goal")).groupBy("source").agg(F.min(F.struct("bucket", before.alias("below"))).alias("b"))
            found = over.select("source", F.col("b.bucket").alias("edge"), F.col("b.below").alias("below"))
        else:
            nearer = (F.col("upto") <= F.col("goal")) | ((before <= F.col("goal")) & (F.col("upto") - F.col("goal") < F.col("goal") - before))
            found = upto.where(nearer).groupBy("source").agg(F.max("bucket").alias("edge"), F.lit(0).cast("long").alias("below"))
        f = found.select(F.col("source").alias("_s"), F.col("edge").alias("_edge"), F.col("below").alias("_below"))
        state = storage.materialize(
            state.join(f, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "whole", "goal", F.coalesce("_below", "below").alias("below"), F.coalesce("_edge", "edge").alias("edge")
            ),
            "mix-state",
        )
    return state.select("source", "source_size", "target", "whole", F.col("edge").alias("last"))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hash_digits(F.col(id_col)).alias("h"))


def copies() -> Column:
    return F.col("whole") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0)


def mix_sources(docs: DataFrame, epochs: int = EPOCHS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (times the text is taken) for every row."""
    base = storage.materialize(sized(docs, id_col, source_col, text_col), "mix-base")
    found = _within(base, thresholds(base, epochs), "source_size", "target", "whole", "last")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), copies().alias("copies"))


def mixed(docs: DataFrame, epochs: int = EPOCHS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    base = storage.materialize(sized(docs, id_col, source_col, text_col), "mix-base")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("source"), hash_digits(F.col(id_col)).alias("h"))
    times = _within(rows, thresholds(base, epochs), "whole", "last").select("row", copies().alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(storage.table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9) AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
shared AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER e, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS weights_left
  FROM ranked
  WINDOW e AS (ORDER BY source_size / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (3 * source_size)::DOUBLE * weights_left::DOUBLE < left_::DOUBLE * weight AS capped FROM shared),
rest AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE AS budget,
         (sum(weight) FILTER (WHERE NOT capped) OVER ())::DOUBLE AS weights
  FROM capped),
targets AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE budget * weight / weights END AS target FROM rest),
goals AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM targets),
units AS (SELECT source, h, sum(size) AS words FROM base GROUP BY source, h),
upto AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM units),
taken AS (
  SELECT u.source, u.h FROM upto u JOIN goals g ON u.source IS NOT DISTINCT FROM g.source
  WHERE u.upto <= g.target - g.whole * g.source_size
     OR (u.upto - u.words <= g.target - g.whole * g.source_size
         AND u.upto - (g.target - g.whole * g.source_size) < (g.target - g.whole * g.source_size) - (u.upto - u.words)))
SELECT b.doc_id, b.size, g.source_size, g.target, (b.size * (g.whole + CASE WHEN t.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken,
       (g.whole + CASE WHEN t.h IS NULL THEN 0 ELSE 1 END)::INTEGER AS copies
FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source
LEFT JOIN taken t ON b.source IS NOT DISTINCT FROM t.source AND b.h = t.h
"""
