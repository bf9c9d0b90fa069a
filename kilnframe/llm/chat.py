"""Chat formatting in budgeted windows of whole turns.

Turns are priced in tokens, and prefix sums of the prices cut a conversation into blocks of BLOCK_WINDOWS windows'
worth, each formatted by itself: within a block, spans of whole turns are filled up to the budget. A window opens with
the conversation's system turn (its first, wherever it stands, repeated in all later windows) and with limited history
repeated from before the span; loss spans cover the texts of assistant turns of the span alone, so each is a target
once. Repeats leave first: history, then the system turn, go where the span's first turn would not fit the budget beside
them. A turn that exceeds the budget by itself is a window of its own, without repeats: nothing is cut or dropped, and no
other window exceeds the budget.

Prefix sums are taken within (conversation, turn div TURN_BUCKET) and over the buckets' totals, so a conversation that
holds a third of all rows is not gathered: its blocks are separate groups of bounded size, to which the system turn and
the history before the block are sent along.

The template writes a turn as ``### Role:`` line, text, ``</turn>`` line. A backslash, and whatever of a text or role
could be read as a mark, is escaped by a backslash, which read_turns undoes.

Defined cases: a null text or role is empty; a null conversation is one of its own; null turns come first; ties of turn
go by role, then text; repeated rows are repeated turns; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage, tokens

BUDGET = 2048
HISTORY = 512
BLOCK_WINDOWS = 32
TURN_BUCKET = 1024
TARGET_ROLE = "assistant"

_MARK = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n", re.S)
_END = "</turn>\n"


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\:\n]", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its escaped text lies in it."""
    head, body = f"### {escape_role(role)}:\n", escape(text)
    return f"{head}{body}\n{_END}", len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end of the escaped text) of every turn of a formatted window. An end mark within a text has a
    backslash before it, so the line that is a bare end mark ends the turn."""
    found, at = [], 0
    while at < len(window):
        head = _HEAD.match(window, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        end = window.index("\n" + _END, head.end())
        found.append((unescape(head[1]), unescape(window[head.end() : end]), head.end(), end))
        at = end + 1 + len(_END)
    return found


class _Conversation:
    """Fills windows of one block, turn by turn in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[int, str, str, int] | None = None
        self.recent: list[tuple[int, str, str, int]] = []
        self.span: list[tuple[int, str, str, int]] = []
        self.context: list[tuple[int, str, str, int]] = []
        self.used = 0

    def _remember(self, turn: tuple[int, str, str, int]) -> None:
        self.recent.append(turn)
        while sum(t[3] for t in self.recent) > self.history:
            self.recent.pop(0)

    def seen(self, turn: tuple[int, str, str, int], is_system: bool) -> None:
        """A turn from before this block."""
        if is_system:
            self.system = turn
        else:
            self._remember(turn)

    def add(self, turn: tuple[int, str, str, int], is_system: bool) -> tuple | None:
        """Takes a turn of this block; gives the window that it doesn't fit in, if one is full."""
        full = None
        if self.span and self.used + turn[3] > self.budget:
            full = self.flush()
        if not self.span:
            self.context = ([self.system] if self.system else []) + self.recent
            self.used = sum(t[3] for t in self.context)
            while self.context and self.used + turn[3] > self.budget:
                self.used -= self.context.pop(1 if self.system and len(self.context) > 1 else 0)[3]
        self.span.append(turn)
        self.used += turn[3]
        if is_system:
            self.system = turn
        else:
            self._remember(turn)
        return full

    def flush(self) -> tuple | None:
        if not self.span:
            return None
        parts, loss, at = [], [], 0
        for k, (_, role, text, _) in enumerate(self.context + self.span):
            formatted, begin, end = turn_text(role, text)
            if k >= len(self.context) and role == TARGET_ROLE:
                loss.append({"begin": at + begin, "end": at + end})
            parts.append(formatted)
            at += len(formatted)
        window = (self.span[0][0], len(self.context), self.used, "".join(parts), loss)
        self.span = []
        return window


def priced(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text and tokens of every formatted turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode_all
        for batch in batches:
            role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            prices = [len(ids) // 4 for ids in encode([turn_text(r, t)[0] for r, t in zip(role, text, strict=True)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prices, pa.int64())], [*batch.schema.names, "tokens"])

    return storage.map_arrow(rows, run, storage.schema_of(conv_id="long", turn="long", role="string", text="string", tokens="long"))


def format_conversations(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    tokenizer: str | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, position (of the window's first own turn), n_context (leading repeated turns), tokens, text and loss
    (begin, end of the masked-in escaped texts) for every window."""
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = storage.materialize(priced(rows, tokenizer or tokens.default_tokenizer()).withColumn("bucket", F.floor(F.col("turn") / TURN_BUCKET)), "turns")
    totals = rows.groupBy("conv_id", "bucket").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    starts = totals.select(
        F.col("conv_id").alias("_c"), F.col("bucket").alias("_b"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("t").over(whole).alias("all_tokens"),
    )
    first = F.min(F.when(F.col("role") == "system", F.struct("turn", F.xxhash64("text").alias("hash"))))
    systems = rows.where(F.col("role") == "system").groupBy(F.col("conv_id").alias("_c")).agg(first.alias("_system"))
    starts = starts.join(systems.withColumnRenamed("_c", "_s"), F.col("_c").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.join(starts, rows["conv_id"].eqNullSafe(starts["_c"]) & rows["bucket"].eqNullSafe(starts["_b"])).drop("_c", "_b")
    is_first = (F.col("role") == "system") & F.col("turn").eqNullSafe(F.col("_system.turn")) & (F.xxhash64("text") == F.col("_system.hash"))
    rows = rows.withColumn("is_system", F.coalesce(is_first, F.lit(False)))
    order = W.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    size = BLOCK_WINDOWS * budget
    start = F.col("t0") + F.coalesce(F.sum("tokens").over(upto), F.lit(0))
    placed = rows.select("conv_id", "role", "text", "tokens", "all_tokens", "is_system", start.alias("start"), (F.col("n0") + F.row_number().over(order) - 1).alias("position"))
    block = F.floor(F.col("start") / size)
    last = F.floor(F.greatest(F.col("all_tokens") - 1, F.lit(0)) / size)
    # A turn goes to its own block, to the next if it ends within the history before it, the system turn to all later ones.
    near = (F.col("start") + F.col("tokens") > (block + 1) * size - history) & (block < last)
    blocks = F.when(F.col("is_system"), F.sequence(block, F.greatest(block, last))).when(near, F.array(block, block + 1)).otherwise(F.array(block))
    sent = placed.select("conv_id", "position", "role", "text", "tokens", block.alias("home"), "is_system", F.explode(blocks).alias("block"))
    dealt = sent.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
        names = ["conv_id", "position", "n_context", "tokens", "text", "loss"]
        key, state = None, _Conversation(budget, history)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for conv, position, role, text, price, home, system, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, at) != key:
                    if window := state.flush():
                        out.append((key[0], *window))
                    key, state = (conv, at), _Conversation(budget, history)
                turn = (position, role, text, price)
                if home != at:
                    state.seen(turn, system)
                elif window := state.add(turn, system):
                    out.append((conv, *window))
            if out:
                yield batch_of(out)
        if key and (window := state.flush()):
            yield batch_of([(key[0], *window)])

    schema = storage.schema_of(conv_id="long", position="long", n_context="int", tokens="long", text="string", loss="array<struct<begin: long, end: long>>")
    return storage.map_arrow(dealt, run, schema)


def digests(windows: DataFrame) -> DataFrame:
    """What a reader of the windows finds, per conversation: its turns without repeats, and the texts under the loss mask.

    A digest reads a conversation in order, so its windows stream through one task, of which a running hash is all that
    is held; formatting itself is not bound to that.
    """
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def row() -> tuple:
            return key[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]

        for batch in batches:
            out = []
            for conv, n_context, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_context", "text", "loss")), strict=True):
                if key != (conv,):
                    if key:
                        out.append(row())
                    key, state = (conv,), {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, said, _, _ in read_turns(text)[n_context:]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["begin"] : span["end"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode("utf-8", "surrogatepass"))
                state["formatted"] += len(text)
            if out:
                yield batch_of(out)
        if key:
            yield batch_of([row()])

    return storage.map_arrow(dealt, run, storage.schema_of(conv_id="long", n_turns="long", turns_sha256="string", loss_chars="long", loss_sha256="string", formatted_chars="long"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = storage.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))
