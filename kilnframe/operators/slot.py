"""The fold of requests for one slot with one place to wait, over Arrow batches in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: (end of the slot's work, whether a request waits, its build, its duration) before any request.
FREE = (-(1 << 63), False, None, None)
STATES = "chunk int, free bigint, waiting boolean, build string, duration bigint"
OUTCOMES = "build string, outcome string, start bigint"


class Slot:
    """The state between batches: the waiting request is the last one seen."""

    def __init__(self, state: tuple) -> None:
        self.free, self.waiting, self.build, self.duration = state

    def state(self) -> tuple:
        return self.free, self.waiting, self.build, self.duration

    def fold(self, batch: pa.RecordBatch) -> tuple[list[int | None], int | None]:
        """(start of each request that is known to run, start of the request that waited before the batch), null otherwise."""
        times, durations = batch.column("at").to_pylist(), batch.column("duration").to_pylist()
        starts: list[int | None] = [None] * len(times)
        free, at_wait, before, length = self.free, -1 if self.waiting else None, None, self.duration
        for i, at in enumerate(times):
            if at_wait is not None and free <= at:
                if at_wait < 0:
                    before = free
                else:
                    starts[at_wait] = free
                free += length
                at_wait = None
            if free <= at:
                starts[i] = at
                free = at + durations[i]
            else:
                at_wait, length = i, durations[i]
        self.free = free
        if times:
            waits = at_wait is not None
            self.waiting, self.build, self.duration = waits, batch.column("build")[-1].as_py() if waits else None, durations[-1] if waits else None
        return starts, before


def fold_states(entries: dict[int, tuple]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state at the end of each chunk, from that at its start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, slot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if slot is None:
                chunk = batch.column("chunk")[0].as_py()
                slot = Slot(entries[chunk])
            slot.fold(batch)
        if slot is not None:
            kinds = (("chunk", pa.int32()), ("free", pa.int64()), ("waiting", pa.bool_()), ("build", pa.string()), ("duration", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip((chunk, *slot.state()), kinds, strict=True)], [name for name, _ in kinds])

    return run


def fold_outcomes(entries: dict[int, tuple], last: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The outcome of each request; one that waits at a chunk's end is told by the next chunk, or, after the last, runs."""

    def rows(builds: list[pa.Array], runs: list[bool], starts: list[int]) -> pa.RecordBatch:
        outcomes = pa.array(["run" if r else "superseded" for r in runs], pa.string())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(builds), outcomes, pa.array(starts, pa.int64())], ["build", "outcome", "start"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, slot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if slot is None:
                chunk = batch.column("chunk")[0].as_py()
                slot = Slot(entries[chunk])
            waited, build = slot.waiting, slot.build
            starts, before = slot.fold(batch)
            times = batch.column("at").to_pylist()
            told = len(times) - slot.waiting  # a request that still waits is told later
            builds, runs = [batch.column("build").cast(pa.string()).slice(0, told)], [s is not None for s in starts[:told]]
            # the next request supersedes one that did not run
            at = [s if s is not None else times[i + 1] for i, s in enumerate(starts[:told])]
            if waited:
                builds, runs, at = [pa.array([build], pa.string()), *builds], [before is not None, *runs], [times[0] if before is None else before, *at]
            yield rows(builds, runs, at)
        if slot is not None and chunk == last and slot.waiting:
            yield rows([pa.array([slot.build], pa.string())], [True], [slot.free])

    return run
