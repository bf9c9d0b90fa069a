"""Quality rules whose cutoffs come from mergeable quantile sketches, in DataFrame functions only.

One pass over the texts measures them inside their rows; nothing is exploded or shuffled. Texts that pass the fixed
base rule feed KLL sketches by (language, source); the sketches of a language's sources merge into the language's and
those into the corpus's. A group's cutoff for a measure is median + SPREAD * (median - 5 % quantile) + slack: both
quantiles lie in the clean half, so junk of up to half a group doesn't move it. Groups of fewer than MIN_GROUP texts
take the language's cutoffs, small languages the corpus's. Rows then join the cutoffs of their group.

Defined cases: a null text has no words and fails the base rule; null languages and sources are groups of their own;
repeated rows are judged alike; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MIN_GROUP = 100
SPREAD = 6.0
SKETCH_K = 2048
#: Measure -> slack above the spread, in the measure's unit.
SLACK = {"symbol_ratio": 0.1, "upper_ratio": 0.1, "mean_word": 1.0, "repeat_ratio": 0.3, "dup_line_ratio": 0.4}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeat_columns(rows: DataFrame) -> DataFrame:
    """n_repeat_words: words in three-word windows that occur twice or more.

    Windows are hashed to 64 bits. Only where a hash repeats within the text are (hash, place) pairs sorted, so equal
    windows are neighbours; neighbours count as equal if their words are.
    """
    n = F.size("_w")
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.withColumn("_t", F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_t", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_t")) < F.size("_t"), placed).otherwise(F.array().cast("array<struct<h: bigint, p: int>>")))

    def same(a: Column, b: Column) -> Column:
        words = [F.get("_w", a["p"] + k) == F.get("_w", b["p"] + k) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & words[0] & words[1] & words[2], F.lit(False))

    again = F.filter("_s", lambda x, i: same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1)))
    rows = rows.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["p"])))
    step = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x))


def measure(docs: DataFrame, columns: list[str], lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """row (the given columns), lang, source and STATS for each row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), text.alias("_text"))
    rows = rows.select("row", "lang", "source", "_text", F.array_remove(F.split("_text", SPACE), "").alias("_w"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    rows = _repeat_columns(rows)
    long = lambda c: c.cast("long")
    return rows.select(
        "row", "lang", "source",
        long(F.size("_w")).alias("n_words"),
        long(F.char_length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.regexp_count("_text", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        "n_repeat_words",
        long(F.size("_l")).alias("n_lines"),
        long(F.regexp_count("_text", F.lit(r"\p{Lu}"))).alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "mean_word": F.col("word_chars") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, n and a KLL sketch of each measure, over the texts that pass the base rule. They merge with those
    of other runs, so a growing corpus needs no second look at old texts."""
    passed = measured.where(~base_failed()).select("lang", "source", *(c.alias(m) for m, c in measures().items()))
    return passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in SLACK))


def cutoffs(by_source: DataFrame) -> DataFrame:
    """lang, source and a cutoff for each measure, from the smallest group that is large enough."""

    def cut(m: str) -> Column:
        middle, low = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.5, 0.05))
        return middle + F.lit(SPREAD) * (middle - low) + F.lit(SLACK[m])

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in SLACK))

    def named(rows: DataFrame, prefix: str, *keys: Column) -> DataFrame:
        return rows.select(*keys, F.col("n").alias(f"{prefix}n"), *(cut(m).alias(f"{prefix}{m}") for m in SLACK))

    by_lang = merged(by_source, "lang")
    own = named(by_source, "s_", F.col("lang"), F.col("source"))
    lang = named(by_lang, "l_", F.col("lang").alias("_lang"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").crossJoin(named(merged(by_lang).where("n > 0"), "c_"))
    pick = lambda m: F.when(F.col("s_n") >= MIN_GROUP, F.col(f"s_{m}")).when(F.col("l_n") >= MIN_GROUP, F.col(f"l_{m}")).otherwise(F.col(f"c_{m}"))
    return joined.select("lang", "source", *(pick(m).alias(m) for m in SLACK))


def judge(docs: DataFrame, columns: list[str], lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """row (the given columns of docs), STATS, base_failed and kept for each row of docs."""
    measured = storage.materialize(measure(docs, columns, lang_col, source_col, text_col), "quality")
    cuts = storage.materialize(cutoffs(storage.materialize(sketches(measured), "sketches")), "cutoffs")
    # Written tables: the planner broadcasts the cutoffs if they lie under its threshold, else shuffles and splits skew.
    cuts = cuts.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(m).alias(f"_{m}") for m in SLACK))
    rows = measured.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for m, value in measures().items():
        within = within & F.coalesce(value <= F.col(f"_{m}"), F.lit(True))
    return rows.select("row", *STATS, base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(storage.table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *STATS[:5], "base_failed", "kept")


_CUTS = "\n".join(
    f"  list_sort(list({m}))[greatest(1, ceil(0.5 * count(*)))::BIGINT] AS q50_{m}, list_sort(list({m}))[greatest(1, ceil(0.05 * count(*)))::BIGINT] AS q05_{m}," for m in SLACK
)
_PICK = ",\n".join(
    f"  CASE WHEN s.n >= {MIN_GROUP} THEN s.q50_{m} + {SPREAD} * (s.q50_{m} - s.q05_{m}) + {SLACK[m]} WHEN l.n >= {MIN_GROUP} THEN l.q50_{m} + {SPREAD} * (l.q50_{m} - l.q05_{m}) + {SLACK[m]}"
    f" ELSE c.q50_{m} + {SPREAD} * (c.q50_{m} - c.q05_{m}) + {SLACK[m]} END AS cut_{m}"
    for m in SLACK
)
#: Exact quantiles: up to SKETCH_K texts a group, a sketch holds every value.
OP5_SQL = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM texts WHERE len(w) >= 3),
grams AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM placed),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM grams, (VALUES (0), (1), (2)) AS t(o) WHERE grams.n > 1 GROUP BY doc_id),
stats AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper
  FROM texts LEFT JOIN covered c USING (doc_id)),
m AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio, n_upper / greatest(word_chars, 1)::DOUBLE AS upper_ratio,
         word_chars / greatest(n_words, 1)::DOUBLE AS mean_word, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio,
         n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio
  FROM stats),
s AS (SELECT lang, source,
{_CUTS}
  count(*) AS n FROM m WHERE NOT base_failed GROUP BY lang, source),
l AS (SELECT lang,
{_CUTS}
  count(*) AS n FROM m WHERE NOT base_failed GROUP BY lang),
c AS (SELECT
{_CUTS}
  count(*) AS n FROM m WHERE NOT base_failed),
cuts AS (SELECT s.lang, s.source,
{_PICK}
  FROM s LEFT JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN c)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({x} <= cut_{x}, TRUE)" for x in SLACK)} AS kept
FROM m LEFT JOIN cuts k ON m.lang IS NOT DISTINCT FROM k.lang AND m.source IS NOT DISTINCT FROM k.source
"""
