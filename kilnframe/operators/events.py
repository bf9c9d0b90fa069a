"""Engine events (seq, t, build, id, ...) folded into counts, states, logs and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LOG_CAP_BYTES
from ..plans.scratch import cut
from ..shipping import ship
from . import graph, slot

#: Requests for one slot that are folded in one task.
CHUNK = 500_000
HITS = ("cache_hit", "remote_cache_hit", "external_cache_hit")
#: Result of a target -> the verb that a renderer shows.
VERBS = {"built": "built", "cache_hit": "cached", "remote_cache_hit": "remote", "external_cache_hit": "exists", "skipped": "skipped", "failed": "failed"}


def build_counts(results: DataFrame) -> DataFrame:
    """build, built, cache_hit, failed, skipped, ok of results (build, result); every kind of hit is a cache_hit."""
    n = lambda c: F.count_if(c).alias
    counted = results.groupBy("build").agg(
        n(F.col("result") == "built")("built"), n(F.col("result").isin(*HITS))("cache_hit"), n(F.col("result") == "failed")("failed"), n(F.col("result") == "skipped")("skipped")
    )
    return counted.withColumn("ok", F.col("failed") == 0)


def verb(result: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))[result]


def latest_state(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last event of each key. max_by pre-aggregates in every task, so a busy key is not gathered."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e")).select(*keys, "_e.*")


def live_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def failed_set(results: DataFrame) -> DataFrame:
    """Failed targets of the latest build, in order of completion."""
    last = results.agg(F.max("build").alias("build"))
    return results.where("result = 'failed'").join(F.broadcast(last), "build").orderBy("seq").select("id")


def last_n(lines: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n lines of each key, with how many were dropped before them."""
    newest = W.partitionBy(*keys).orderBy(F.desc(order))
    total = lines.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("dropped"))
    kept = lines.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
    return kept.join(total, keys)


def capped_log(lines: DataFrame, keys: list[str], order: str, text: str = "line", cap: int = LOG_CAP_BYTES) -> DataFrame:
    """Lines (with their line break) until a stream's bytes reach the cap; the one that reaches it is marked and last."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    size = F.octet_length(text) + 1
    upto = lines.withColumn("bytes_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return upto.where(F.col("bytes_before") < cap).withColumn("truncated", F.col("bytes_before") + size > cap)


def replay(blobs: DataFrame) -> DataFrame:
    """id, stream, pos, line of stored logs (id, stdout, stderr): stdout first, by lines; a last line break ends a line."""
    both = blobs.select("id", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("stdout").alias("stream"), F.col("stdout").alias("t")), F.struct(F.lit(1).alias("o"), F.lit("stderr").alias("stream"), F.col("stderr").alias("t")))).alias("s"))
    split = both.where("s.t IS NOT NULL AND s.t <> ''").select("id", "s.o", "s.stream", F.posexplode(F.split(F.regexp_replace("s.t", r"\n\z", ""), r"\r?\n")))
    return split.select("id", "stream", F.col("pos"), F.col("col").alias("line"), "o").orderBy("id", "o", "pos").drop("o")


def log_lines(lines: DataFrame, stdout: bool = True, stderr: bool = True, merged: bool = False, search: str = "") -> DataFrame:
    """lines (stream, line and others) of the wanted streams with the sink (out, err) each is written to; merged sends all to
    out. A search keeps lines that hold it, in any case. Lines of other streams are none."""
    wanted = [name for name, want in (("stdout", stdout), ("stderr", stderr)) if want]
    found = F.col("stream").isin(*wanted) if wanted else F.lit(False)
    if search:
        found = found & F.lower("line").contains(search.lower())
    sink = F.lit("out") if merged else F.when(F.col("stream") == "stdout", "out").otherwise("err")
    return lines.where(found).withColumn("sink", sink)


def kept_output(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Buffered lines of targets that failed; those of others are dropped."""
    return lines.join(results.where("result = 'failed'").select("id"), "id", "left_semi")


def renderer_rows(results: DataFrame, hidden_tags: list[str], quiet: bool = False) -> DataFrame:
    """Results to show: hidden-tagged targets only if they failed; in quiet mode failures alone."""
    failed = F.col("result") == "failed"
    if quiet:
        return results.where(failed)
    hidden = F.arrays_overlap("tags", F.array(*map(F.lit, hidden_tags))) if hidden_tags else F.lit(False)
    return results.where(failed | ~F.coalesce(hidden, F.lit(False)))


def skip_propagation(failed: DataFrame, edges: DataFrame, needed: DataFrame) -> DataFrame:
    """label, reason of targets (of needed: label) that can't run: all that needs a failed one. reason is the smallest
    direct dependency that failed or was skipped."""
    reached = graph.closure(failed, edges, downstream=True)
    bad = reached.select(F.col("label").alias("dep"))
    skipped = reached.where("depth > 0").select("label").join(needed.select("label"), "label", "left_semi").join(failed.select("label"), "label", "left_anti")
    reasons = edges.join(bad, "dep", "left_semi").groupBy(F.col("parent").alias("label")).agg(F.min("dep").alias("reason"))
    return skipped.join(reasons, "label")


def silent_gaps(lines: DataFrame, keys: list[str], ts: str, least_secs: int = 3) -> DataFrame:
    """Beats of silence: for each gap between a key's lines, one for every whole second from least_secs on."""
    following = F.lead(ts).over(W.partitionBy(*keys).orderBy(ts))
    gap = F.floor((F.unix_micros(F.col("_next")) - F.unix_micros(F.col(ts))) / 1_000_000)
    gaps = lines.withColumn("_next", following).withColumn("gap_secs", gap).where(F.col("gap_secs") >= least_secs)
    return gaps.select(*keys, F.col(ts).alias("silent_since"), F.explode(F.sequence(F.lit(least_secs).cast("long"), F.col("gap_secs"))).alias("secs"))


def debounce(events: DataFrame, keys: list[str], ts: str, path: str, quiet_us: int, max_us: int) -> DataFrame:
    """batch, first, last, flushed, paths for each key: a batch opens with an event and is flushed at the earlier of
    last + quiet and first + max; an event at or after that time opens the next.

    The cap makes batches depend on those before, so a key's times are folded in order. Sessions by quiet alone never
    touch one another, so the fold runs within a session, and a busy key is folded in as many groups as it has pauses.
    """
    us = F.unix_micros(F.col(ts))
    order = W.partitionBy(*keys).orderBy("_us")
    timed = events.select(*keys, us.alias("_us"), F.col(path).alias("_path"))
    opens = F.coalesce((F.col("_us") - F.lag("_us").over(order) >= quiet_us).cast("int"), F.lit(1))
    sessions = timed.withColumn("_open", opens).withColumn("_session", F.sum("_open").over(order.rangeBetween(W.unboundedPreceding, 0)))
    moments = sessions.groupBy(*keys, "_session", "_us").agg(F.collect_set("_path").alias("_paths"))
    ordered = moments.groupBy(*keys, "_session").agg(F.array_sort(F.collect_list(F.struct("_us", "_paths"))).alias("_m"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint,paths:array<string>>>")

    def step(done: Column, m: Column) -> Column:
        open_ = F.element_at(done, -1)
        new = F.array(F.struct(m["_us"].alias("first"), m["_us"].alias("last"), m["_paths"].alias("paths")))
        grown = F.array(F.struct(open_["first"].alias("first"), m["_us"].alias("last"), F.array_union(open_["paths"], m["_paths"]).alias("paths")))
        flush = F.least(open_["last"] + quiet_us, open_["first"] + max_us)
        return F.when((F.size(done) == 0), F.concat(done, new)).when(m["_us"] >= flush, F.concat(done, new)).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), grown))

    folded = ordered.select(*keys, F.explode(F.aggregate("_m", empty, step)).alias("b"))
    flushed = F.least(F.col("b.last") + quiet_us, F.col("b.first") + max_us)
    number = F.row_number().over(W.partitionBy(*keys).orderBy("b.first"))
    return folded.select(*keys, number.alias("batch"), F.col("b.first").alias("first_us"), F.col("b.last").alias("last_us"), flushed.alias("flushed_us"), F.array_sort("b.paths").alias("paths"))


def quiet_sessions(events: DataFrame, keys: list[str], ts: str, quiet_us: int) -> DataFrame:
    """Sessions split by quiet alone: keys, session, first_us, last_us, n."""
    us = F.unix_micros(F.col(ts))
    order = W.partitionBy(*keys).orderBy("_us")
    timed = events.select(*keys, us.alias("_us"))
    opens = F.coalesce((F.col("_us") - F.lag("_us").over(order) >= quiet_us).cast("int"), F.lit(1))
    numbered = timed.withColumn("_open", opens).withColumn("session", F.sum("_open").over(order.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count(F.lit(1)).alias("n"))


def distinct_until_changed(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; a null value (an error) lets the next one through."""
    before = F.lag(F.struct(value)).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col(value).isNotNull() & ~F.col(f"_before.{value}").eqNullSafe(F.col(value))).drop("_before")


def single_slot(commands: DataFrame) -> DataFrame:
    """outcome of build requests (build, requested, started, finished bounds given by duration): with one slot running
    and one waiting, a newer request supersedes the waiting one.

    commands: build, at, duration (both in the same unit), in order of at, then build and duration; without at or duration
    it is no request. Returns build, outcome (run, superseded), start.

    Requests are sorted into chunks, and each is folded in one task that holds the slot's end and the waiting request alone.
    Where a chunk begins depends on those before. At first all start with a free slot; those that should have started
    otherwise are folded again, together, twice at most, as histories soon meet in one state. Chunks that are still unsettled
    then are folded one after the other, so the work stays in proportion to the requests.
    """
    asked = commands.where("at IS NOT NULL AND duration IS NOT NULL").select("at", "build", "duration")
    n = max(1, -(-asked.count() // CHUNK))
    ranged = asked.repartitionByRange(n, "at", "build", "duration").sortWithinPartitions("at", "build", "duration")
    chunks = cut(ranged.select(F.spark_partition_id().alias("chunk"), F.col("build").cast("string").alias("build"), F.col("at").cast("bigint").alias("at"), F.col("duration").cast("bigint").alias("duration")))
    ship(commands.sparkSession)
    exits: dict[int, tuple] = {}
    used: dict[int, tuple] = {}

    def fold(entries: dict[int, tuple]) -> None:
        rows = chunks.where(F.col("chunk").isin(*entries)).mapInArrow(slot.fold_states(entries), slot.STATES).collect()
        exits.update({r["chunk"]: (r["free"], r["waiting"], r["build"], r["duration"]) for r in rows})
        used.update(entries)

    def stale() -> dict[int, tuple]:
        """Chunks whose entry is not the exit of those before, and that exit."""
        out, state = {}, slot.FREE
        for chunk in range(n):
            if chunk in used and used[chunk] != state:
                out[chunk] = state
            state = exits.get(chunk, state)
        return out

    fold(dict.fromkeys(range(n), slot.FREE))
    rounds = 0
    while wrong := stale():
        fold(wrong if rounds < 2 else dict([next(iter(wrong.items()))]))
        rounds += 1
    last = max(exits, default=0)
    return chunks.mapInArrow(slot.fold_outcomes(used, last), slot.OUTCOMES)


def until_terminal(events: DataFrame, terminal: list[str], order: str = "seq") -> DataFrame:
    """Events up to the first terminal one."""
    end = events.where(F.col("t").isin(*terminal)).agg(F.min(order).alias("_end"))
    return events.join(F.broadcast(end), F.coalesce(F.col(order) <= F.col("_end"), F.lit(True))).drop("_end").orderBy(order)
