"""Best-fit packing of token sequences by linear grouping.

Method
    1. Executors turn texts into ids (the tokenizer runs once for each distinct space-separated chunk;
       its pre-tokenizer never joins chunks over white space) and cut documents longer than `capacity`.
       Only (doc_id, piece, start, length, checksum) goes on.
    2. The driver gets one count per length: at most `capacity` numbers, whatever the input.
    3. Lengths above a share of the capacity are put, longest first, in groups of equal cardinality and rounded
       up to their group's longest. A linear program over configurations of these few sizes (column
       generation; pricing by a knapsack) gives how often each configuration is used.
    4. Actual documents take the slots of their group, so what rounding added is free again. Large ones
       left over, then small ones, go best-fit in decreasing length. All this works on runs of equal
       lengths, so its cost follows the number of distinct lengths and not the number of rows.
    5. A piece finds its place by its rank among pieces of its length. Ranks come from counts by
       (length, hash bucket) and row numbers inside, so a length that a third of all rows share is
       spread over buckets.

Defined results: a null or empty text has the one id that ends a document; repeated rows are packed
each for itself; null ids are packed too. An empty table gives an empty result. Ties in length fall to
the smaller (doc_id, piece) inside a hash bucket. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import bisect
import os
import string
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, lean, slices, written

END_ID = 1


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    #: (least share of `capacity` that counts as large, groups): each is planned, the fewest sequences win.
    settings: tuple[tuple[float, int], ...] = ((0.25, 8), (0.25, 24), (0.4, 12), (0.4, 40), (0.55, 16), (0.75, 16))
    unit: int = 16


class IdCache(dict):
    """Chunk of text to its ids (little-endian 32-bit), two generations of at most `most` chunks.

    The pre-tokenizer ends a token where letters meet ASCII punctuation, so a word and the marks after it
    are looked up apart if the word still ends in a letter when the normaliser has composed and lower-cased
    it (a capital dotted I doesn't). A word of lower-case letters in composed form is one pre-token that the
    normaliser leaves as it is: it goes to the BPE model at once, as byte-level characters. All other
    chunks take the whole encoder.
    """

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # the model is a part of the tokenizer, which has to live as long
        self.tokenizer = Tokenizer.from_file(path)
        self.encode, self.word, self.most, self.old = self.tokenizer.encode, self.tokenizer.model.tokenize, most, {}
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                if chunk.islower() and chunk == chunk.lower() and unicodedata.is_normalized("NFC", chunk):
                    ids = [t.id for t in self.word(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_LEVEL))]
                    ids = struct.pack(f"<{len(ids)}I", *ids)
                elif (low := chunk.lower()) != chunk and low.isalpha() and "Σ" not in chunk:
                    ids = self[low]
            elif (body := chunk.rstrip(string.punctuation)) != chunk and body.isalpha() and (body.isascii() or unicodedata.normalize("NFC", body).lower()[-1].isalpha()):
                ids = self[body] + self[chunk[len(body) :]]
            if ids is None:
                ids = np.array(self.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _byte_level() -> dict[int, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


def id_cache(path: str) -> IdCache:
    caches = held("pack")
    if path not in caches:
        caches[path] = IdCache(path)
    return caches[path]


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    cache, end = id_cache(path), np.array([END_ID], "<u4").tobytes()
    for whole in batches:
        for batch in slices(whole, "text", 16 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = cache.ids(text.as_py() or "") + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(lambda it: _cut(it, tokenizer, capacity), "pack"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- planning, on counts by length ---


def _knapsack(sizes: list[int], values: np.ndarray, room: int) -> tuple[float, list[int]]:
    best, pick = [0.0] * (room + 1), [-1] * (room + 1)
    items = [(s, float(v), i) for i, (s, v) in enumerate(zip(sizes, values, strict=True)) if v > 1e-12 and s <= room]
    for c in range(1, room + 1):
        b, p = best[c - 1], -1
        for s, v, i in items:
            if s <= c and best[c - s] + v > b + 1e-12:
                b, p = best[c - s] + v, i
        best[c], pick[c] = b, p
    counts, c = [0] * len(sizes), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[room], counts


def configurations(sizes: list[int], counts: list[int], room: int, most_rounds: int = 400) -> list[tuple[list[int], float]]:
    """Fractional optimum of covering `counts` items of few `sizes` by configurations that fit `room`."""
    k = len(sizes)
    base = [[room // s if j == i else 0 for j in range(k)] for i, s in enumerate(sizes)]
    inverse, x = np.diag([1.0 / (room // s) for s in sizes]), np.array([n / (room // s) for n, s in zip(counts, sizes, strict=True)])
    for _ in range(most_rounds):
        duals = inverse.sum(axis=0)
        value, column = _knapsack(sizes, duals, room)
        if value <= 1 + 1e-7:
            break
        d = inverse @ np.array(column, float)
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(ratio.argmin())
        t = ratio[r]
        x = np.maximum(x - t * d, 0)
        x[r] = t
        base[r] = column
        inverse[r] /= d[r]
        for i in range(k):
            if i != r:
                inverse[i] -= d[i] * inverse[r]
    return [(c, float(v)) for c, v in zip(base, x, strict=True) if v > 0]


class _Runs:
    """Runs of ranks of one length each; taken from the front."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = runs[::-1]  # (length, first rank, count)

    def take(self, most: int) -> tuple[int, int, int] | None:
        if not self.runs:
            return None
        length, first, n = self.runs.pop()
        if n > most:
            self.runs.append((length, first + most, n - most))
            n = most
        return length, first, n


def plan(counts: np.ndarray, p: Packing) -> tuple[np.ndarray, int]:
    """The best plan among the settings; see `plan_one`."""
    return min((plan_one(counts, p.capacity, int(share * p.capacity), groups, p.unit) for share, groups in p.settings), key=lambda x: x[1])


def plan_one(counts: np.ndarray, room: int, large: int, n_groups: int, unit: int) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, count, first sequence, offset) and the number of sequences.

    counts[n] is how many pieces have n tokens. A segment puts consecutive ranks of a length in
    consecutive sequences, all at the same offset.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    total = 0
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs of (first sequence, count)
    free: list[int] = []

    def put_back(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if not space[left]:
                bisect.insort(free, left)
            space[left].append((first, n))

    def best_fit(length: int, rank: int, n: int) -> None:
        nonlocal total
        while n:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = room // length
                full, rest = divmod(n, each)
                for j in range(each):
                    if full:
                        segments.append((length, rank + j * full, full, total, j * length))
                put_back(room - each * length, total, full)
                total += full
                for j in range(rest):
                    segments.append((length, rank + each * full + j, 1, total, j * length))
                if rest:
                    put_back(room - rest * length, total, 1)
                    total += 1
                return
            left = free[at]
            first, m = space[left].pop()
            if not space[left]:
                free.pop(at)
            use = min(m, n)
            segments.append((length, rank, use, first, room - left))
            put_back(left, first + use, m - use)
            put_back(left - length, first, use)
            rank, n = rank + use, n - use

    n_large = int(counts[large + 1 :].sum())
    rest: list[tuple[int, int, int]] = []
    if n_large:
        groups: list[list[tuple[int, int, int]]] = []
        size = -(-n_large // n_groups)
        left = 0
        for length in range(len(counts) - 1, large, -1):
            rank, n = 0, int(counts[length])
            while n:
                if not left:
                    groups.append([])
                    left = size
                use = min(left, n)
                groups[-1].append((length, rank, use))
                rank, n, left = rank + use, n - use, left - use
        units = [-(-g[0][0] // unit) for g in groups]
        sizes = sorted(set(units), reverse=True)
        runs = {s: _Runs([r for g, u in zip(groups, units, strict=True) if u == s for r in g]) for s in sizes}
        need = [sum(r[2] for r in runs[s].runs) for s in sizes]
        for column, times in sorted(configurations(sizes, need, room // unit), reverse=True):
            times = int(times + 1e-6)
            if not times:
                continue
            bins = [(total, times, 0)]
            total += times
            for s, how_many in zip(sizes, column, strict=True):
                for _ in range(how_many):
                    after = []
                    for first, n, used in bins:
                        while n:
                            got = runs[s].take(n)
                            if got is None:
                                after.append((first, n, used))
                                break
                            length, rank, m = got
                            segments.append((length, rank, m, first, used))
                            after.append((first, m, used + length))
                            first, n = first + m, n - m
                    bins = after
            for first, n, used in bins:
                put_back(room - used, first, n)
        rest = [r for s in sizes for r in runs[s].runs]
    rest += [(n, 0, int(counts[n])) for n in range(min(large, len(counts) - 1), 0, -1) if counts[n]]
    for length, rank, n in sorted(rest, key=lambda r: (-r[0], r[1])):
        best_fit(length, rank, n)
    out = np.array(segments, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], total


def _place(batches: Iterator[pa.RecordBatch], segments: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (segments[:, 0] << 48) | segments[:, 1]
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) | rank, "right") - 1
        s = segments[at]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, p: Packing = Packing()) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = written(pieces(docs, tokenizer, p.capacity), "pack-pieces")
    n = found.count()
    buckets = int(min(4096, max(32, -(-n // 200_000))))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by = found.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(p.capacity + 1, np.int64)
    for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r[0]] = r[1]
    segments, _ = plan(counts, p)
    before = by.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = found.withColumn("row", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(lean(lambda it: _place(it, segments), "pack"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def in_order(packed: DataFrame, places: DataFrame) -> DataFrame:
    """The same packing, its sequences numbered by the first place that a document of theirs has.

    `places` gives (doc_id, place) with any sortable place; documents without one come first. Numbers rise
    with the order and have gaps.
    """
    own = packed.join(places.groupBy(F.col("doc_id").alias("id")).agg(F.min("place").alias("place")).hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    first = own.groupBy("sequence_id").agg(F.min(F.struct(F.coalesce(F.col("place").isNotNull(), F.lit(False)).alias("known"), "place", "doc_id", "piece")).alias("first"))
    ranked = written(first.repartitionByRange("first").sortWithinPartitions("first").select("sequence_id", F.monotonically_increasing_id().alias("number")), "pack-order")
    return packed.join(ranked.hint("merge"), "sequence_id").select(*(F.col("number").alias(c) if c == "sequence_id" else F.col(c) for c in packed.columns))
