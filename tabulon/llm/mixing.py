"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut in blocks, and a slot takes one block. All sources that have blocks left share
every slot in proportion to their weights (real numbers; nothing is rounded), so each source has a curve
of what it should have got by slot t; where a source ends, the others' curves get steeper. A source's i-th
block (from 1) is released at the floor of the time when its curve passes i - 1 and due at the ceiling of
the time when it reaches i; in every slot the earliest deadline among released blocks goes first (ties:
the source's name). Each source then stays less than one block from its curve at every slot.

The schedule is worked out in segments that need nothing from each other. At a border T every source has
got the floor or the ceiling of its curve. Which of the two: the earliest-deadline run of one segment's
length that ends at T says so, begun from the state that rounds up the sources whose next deadlines are
earliest (from that state all later deadlines can be met, by counting windows inside an interval). Between
two borders blocks run by earliest deadline, each due at the end border at the latest; both borders leave
room for that, so executors fill any segment alone. A segment is so long that each source gets a block in it. Times are doubles: where a curve passes a whole number
within rounding, a block may move by a slot.

The driver holds two numbers and a name a source, whatever the number of rows or slots. Rows of a source
are dealt to hash buckets that grow in number with the source, and blocks are cut inside buckets, so a
source with a third of all rows is no single group. Nothing is dropped or repeated.

Defined results: null and empty sources are one source, ''. Sources that `weights` doesn't list, or
lists with 0, follow once all others are used up, in equal shares. An empty table gives an empty result; a
null id is placed as any other; repeated rows are placed each for itself, ties between equal rows fall
either way. Only `doc_id` and the source column are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mix:
    block_rows: int = 16
    #: Slots a segment, at least (see `Curves.length`).
    segment: int = 4096
    blocks_a_bucket: int = 64
    temper: float = 0.5
    broadcast_sources: int = 10_000
    seed: int = 7


_NEAR = 1e-9
#: Slots worked through at a time.
_STRETCH = 1 << 16


class Curves:
    """What sources with `blocks` blocks and `weights` should have got by each slot, from slot `start`."""

    def __init__(self, ids: np.ndarray, blocks: np.ndarray, weights: np.ndarray, start: int = 0):
        self.ids, self.n, self.start = ids, blocks.astype(np.int64), start
        self.w = weights / weights.sum()
        self.slots = int(self.n.sum())
        # `depth` is how much a source of weight 1 has got; a source ends at depth n / w
        ends = np.unique(self.n / self.w)
        order = np.argsort(self.n / self.w, kind="stable")
        at = np.searchsorted((self.n / self.w)[order], ends, "right")
        done, open_ = np.append(0, np.cumsum(self.n[order]))[at], self.w.sum() - np.append(0, np.cumsum(self.w[order]))[at]
        self.depths, self.times = np.append(0.0, ends), np.append(0.0, done + np.maximum(open_, 0) * ends)
        self.times[-1] = self.slots

    def time(self, source: np.ndarray, got: np.ndarray) -> np.ndarray:
        """When a source's curve passes `got` blocks."""
        return np.interp(got / self.w[source], self.depths, self.times)

    def release(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        x = self.time(source, block - 1)
        return np.floor(x + _NEAR * (1 + x)).astype(np.int64)

    def deadline(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        x = self.time(source, block)
        return np.ceil(x - _NEAR * (1 + x)).astype(np.int64)

    def due(self, t: int) -> np.ndarray:
        """Each source's curve at slot t."""
        return np.minimum(self.n, self.w * np.interp(t, self.times, self.depths))

    def rounded(self, t: int) -> np.ndarray:
        """Blocks got by slot t: curves rounded down, and up where the next deadlines are earliest."""
        if t >= self.slots:
            return self.n.copy()
        curve = self.due(t)
        got = np.floor(curve + _NEAR * (1 + curve)).astype(np.int64)
        short = t - int(got.sum())
        if short > 0:
            can = np.flatnonzero(got < self.n)
            first = np.lexsort((can, self.deadline(can, got[can] + 1)))[:short]
            got[can[first]] += 1
        elif short < 0:  # rounding took blocks that are due within a hair
            last = np.argsort(curve - got, kind="stable")[:-short]
            got[last] -= 1
        return got

    def length(self, least: int) -> int:
        """Slots a segment: every source that lasts gets a block in it, so no border takes one back."""
        return max(least, 4 * len(self.n), int(np.ceil(1 / self.w.min())))

    def run(self, begin: int, end: int, got: np.ndarray, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Earliest deadline first over slots begin to end - 1: source and block of each slot, in stretches.

        `last` names the state to end in; without it, blocks that are released may be left over.
        """
        top = self.n if last is None else last
        made = got.copy()
        waiting: list[tuple[int, int, int, int]] = []
        ready: list[tuple[int, int, int]] = []
        for a in range(begin, end, _STRETCH):
            b = min(end, a + _STRETCH)
            most = np.minimum(top, np.ceil(self.due(b)).astype(np.int64) + 1)
            many = np.maximum(most - made, 0)
            source = np.repeat(np.arange(len(made)), many)
            block = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(made, many) + 1
            made = made + many
            release, deadline = self.release(source, block), self.deadline(source, block)
            if last is not None:
                deadline = np.minimum(deadline, end)
            waiting = sorted([*waiting, *zip(release.tolist(), deadline.tolist(), source.tolist(), block.tolist(), strict=True)])
            at, taken = 0, []
            for t in range(a, b):
                while at < len(waiting) and (waiting[at][0] <= t or not ready):  # doubles: never leave a slot empty
                    heapq.heappush(ready, waiting[at][1:])
                    at += 1
                taken.append(heapq.heappop(ready)[1:])
            del waiting[:at]
            out = np.array(taken, np.int64).reshape(-1, 2)
            yield out[:, 0], out[:, 1]

    def border(self, t: int, length: int) -> np.ndarray:
        """What each source has got by the border t."""
        if t <= 0 or t >= self.slots:
            return self.rounded(max(t, 0))
        begin = max(0, t - length)
        got = self.rounded(begin)
        for source, _ in self.run(begin, t, got.copy()):
            got = got + np.bincount(source, minlength=len(got))
        return got

    def segment(self, k: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Source, block, slot, release and deadline of every slot of segment k, in stretches."""
        at, end = k * length, min(self.slots, (k + 1) * length)
        for source, block in self.run(at, end, self.border(at, length), self.border(end, length)):
            yield self.ids[source], block, np.arange(at, at + len(source)) + self.start, self.release(source, block) + self.start, self.deadline(source, block) + self.start
            at += len(source)


def curves(blocks: list[int], weights: list[float]) -> list[Curves]:
    """Curves of the weighted sources, and after them those of the others."""
    n, w = np.array(blocks, np.int64), np.array(weights, float)
    out, start = [], 0
    for pick, rate in ((w > 0, w), (w <= 0, np.ones(len(w)))):
        ids = np.flatnonzero(pick & (n > 0))
        if len(ids):
            out.append(Curves(ids, n[ids], rate[ids], start))
            start += out[-1].slots
    return out


_SLOTS = "sid int, block long, slot long, phase int, release long, deadline long"


def _fill(batches: Iterator[pa.RecordBatch], parts: list[Curves], least: int) -> Iterator[pa.RecordBatch]:
    firsts = np.cumsum([0, *(-(-c.slots // c.length(least)) for c in parts)])
    for batch in batches:
        for k in batch.column("id").to_pylist():
            c = int(np.searchsorted(firsts, k, "right")) - 1
            for sid, block, slot, release, deadline in parts[c].segment(k - int(firsts[c]), parts[c].length(least)):
                phase = np.searchsorted(parts[c].times[1:], slot - parts[c].start, "right") + sum(len(x.times) - 1 for x in parts[:c])
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int32()), pa.array(block - 1), pa.array(slot), pa.array(phase, pa.int32()), pa.array(release), pa.array(deadline)], names=["sid", "block", "slot", "phase", "release", "deadline"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, p: Mix = Mix(), source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """doc_id, source, phase, block, slot, place, release, deadline of each row; `slot, place` is the mixed order.

    Without `weights`, a source's weight is its number of rows to the power `temper`. `phase` counts the
    sources' ends before the slot.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    counted = dict(sorted((r[0], r[1]) for r in rows.groupBy("source").agg(F.count(F.lit(1))).collect()))
    spread = p.block_rows * p.blocks_a_bucket
    # counted above: few sources are broadcast, so that a hot source isn't shuffled to one task; many are joined by a shuffle
    small = F.broadcast if len(counted) <= p.broadcast_sources else lambda x: x
    named = small(spark.createDataFrame([(s, i, -(-n // spread)) for i, (s, n) in enumerate(counted.items())], "source string, sid int, buckets long"))
    dealt = rows.join(named, "source").withColumn("h", F.xxhash64(F.lit(p.seed), "doc_id")).withColumn("bucket", F.pmod("h", "buckets"))
    by = dealt.groupBy("sid", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.block_rows)).alias("blocks"))
    total = {r[0]: r[1] for r in by.groupBy("sid").agg(F.sum("blocks")).collect()}
    parts = curves([total.get(i, 0) for i in range(len(counted))], [n**p.temper if weights is None else weights.get(s, 0.0) for s, n in counted.items()])
    segments = sum(-(-c.slots // c.length(p.segment)) for c in parts)
    slots = spark.range(0, segments, 1, max(1, min(segments, 100_000))).mapInArrow(lambda it: _fill(it, parts, p.segment), _SLOTS)
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by.select("sid", "bucket", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("before"))
    order = F.row_number().over(Window.partitionBy("sid", "bucket").orderBy("h", "doc_id")) - 1
    placed = dealt.select("doc_id", "source", "sid", "bucket", order.alias("n")).join(firsts, ["sid", "bucket"])
    block = F.col("before") + F.floor(F.col("n") / p.block_rows)
    placed = placed.select("doc_id", "source", "sid", block.alias("block"), (F.col("n") % p.block_rows).cast("int").alias("place"))
    return placed.join(slots, ["sid", "block"]).select("doc_id", "source", "phase", "block", "slot", "place", "release", "deadline")
