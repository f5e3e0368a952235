"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of `length` bytes that covers it starts earlier too: in a smaller doc_id, or
earlier in its own document. Matches stay inside documents; all is judged on the input.

Which suffixes take part. Of the `length - gram + 1` grams in a window the one of least hash (leftmost
of ties) is the window's anchor; equal windows have equal anchors at equal places. So windows fall in
runs that share an anchor, about one run for each 35 bytes, and only runs whose anchor gram occurs
again can hold repeated windows. Runs that are equal as a whole (same digest of all their bytes) need
no finer look: all but the earliest are repeats. Shards leave those out before they send anything,
so a group of copies costs a row per shard.

What remains (runs at the edges of repeated passages) is settled by the transform: the runs' bytes are
read as strings over symbols of `symbol` bytes, one string per phase. Each shard's strings are sorted
into its Burrows-Wheeler transform; the transforms are merged by refining an interleave, one round a
symbol: in round t the interleave is correct for the first t symbols, walking it and dealing each
entry to its preceding symbol's bucket gives round t + 1, and a bucket border that appears in round t
is a common prefix of t - 1 symbols. No suffix is sorted anew. Intervals without a border after
`length / symbol` rounds are strings repeated over `length` bytes; all but the earliest are covered.

Anchors with more than `hot` different runs (a line that a third of all documents hold) are cut into
blocks of a few windows, keyed by what the block's windows have in common, and equal blocks are merged
inside a shard before the shuffle; no such group meets in one task. A shard that holds many different
runs of an anchor already sends them to that path and only a mark to the anchor's task, so that a task
gets a row a shard of it and not one a document.

Defined results: null and empty texts have 0 bytes; texts shorter than `length` keep all. If ids repeat
or are null, rows are ordered by (doc_id, text) and each row is a document of its own (nulls first).
An empty table gives an empty result. Only `doc_id` and `text` are read; `without_repeats` hands all other
columns on, whatever their names. Digests have 64 bits for
anchors, another 64 for runs, 64 a symbol; equality of strings rests on at least 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, free_shuffles, fresh, held, lean, mix64, odd_inverse, powers, slices, utf8, written

_BASE = 0xD1342543DE82EF95 | 1
_INV = odd_inverse(_BASE)
_BYTE = mix64(np.arange(1001, 1257, dtype=np.uint64))


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    gram: int = 24
    symbol: int = 25
    hot: int = 20_000
    #: Different runs of one anchor in one flush that make it hot at once (more where flushes are few, see `covered`).
    hot_here: int = 64
    hot_windows: int = 4
    chunk: int = 1 << 19
    flush: int = 1 << 19
    shard_mb: int = 32
    #: Bytes of strings that one transform merge takes, and those that one task works through, merge after merge.
    merge_bytes: int = 1 << 19
    task_bytes: int = 1 << 23


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    known, size = held("repeats"), 1 << max(10, n.bit_length())
    if size not in known:
        known[size] = powers(_BASE, size), powers(_INV, size)
    return known[size]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the rolling digest and the factors that move a difference to position 0."""
    up, down = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out, down


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    grid = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    grid[:n] = v
    grid = grid.reshape(-1, w)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], np.minimum.accumulate(grid, axis=1).ravel()[w - 1 : n])


def runs(data: np.ndarray, offs: np.ndarray, p: Repeats) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of window starts that share an anchor: row, first start (in its text), anchor - start, windows, gram digest, run digest."""
    n_all, k, length = len(data), p.gram, p.length
    for c in range(0, max(0, n_all - length + 1), p.chunk):
        seg = data[c : c + p.chunk + length - 1]
        n = len(seg)
        n_win = n - length + 1
        sums, down = _sums(seg)
        gram = mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])
        place = np.uint64((1 << 22) - 1)
        least = sliding_min((gram & ~place) | np.arange(n - k + 1, dtype=np.uint64), length - k + 1)[:n_win]
        anchor = (least & place).astype(np.int64)
        # starts whose window would cross the end of its text
        steps = np.zeros(n_win + 1, np.int32)
        ends = offs[1:]
        first = np.maximum(offs[:-1], ends - length + 1)
        np.add.at(steps, np.clip(first - c, 0, n_win), 1)
        np.add.at(steps, np.clip(ends - c, 0, n_win), -1)
        at = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
        if not len(at):
            continue
        anchor = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        lo, hi, q = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])], anchor[new]
        row = np.searchsorted(offs, lo + c, "right") - 1
        whole = mix64((sums[hi + length] - sums[lo]) * down[lo]) + (q - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        yield row, lo + c - offs[row], q - lo, hi - lo + 1, gram[q], mix64(whole)


# --- packed columns, so that a shuffle moves few large rows ---


def _pack(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), *(x for c in columns for x in (ord(c.dtype.char), c.nbytes))], "<i8")
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for i in range(n):
        kind, size = np.dtype(chr(head[2 * i])), int(head[2 * i + 1])
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


_BLOBS = "part int, kind int, blob binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "blob"])


def _split(part: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    return _blobs([(int(part[a]), kind, _pack(*(c[order[a:b]] for c in columns))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _later(*keys: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys, then document and start: the order, where a group begins, and the group of each."""
    order = np.lexsort((lo, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new, np.cumsum(new) - 1


def _shard(batches: Iterator[pa.RecordBatch], p: Repeats, parts: int, many: int) -> Iterator[pa.RecordBatch]:
    """Runs of one task's texts, equal runs merged.

    Kind 0 is covered already; 1 goes to its anchor's part; 2 are runs of anchors with more than `many`
    different runs here, which need not meet; -1 marks those anchors in their part.
    """
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def send() -> Iterator[pa.RecordBatch]:
        doc, lo, dq, n, gram, whole = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, new, _ = _later(gram, whole, doc=doc, lo=lo)
        rep, rest = order[new], order[~new]
        first = np.flatnonzero(np.concatenate([[True], gram[rep][1:] != gram[rep][:-1]]))
        size = np.diff(np.append(first, len(rep)))
        hot = np.repeat(size > many, size)
        own = lambda g: (g % np.uint64(parts)).astype(np.int32)
        by_doc = lambda r: (mix64(doc[r].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        cool, hot, marks = rep[~hot], rep[hot], gram[rep[first[size > many]]]
        if len(cool):
            yield _split(own(gram[cool]), 1, *(x[cool] for x in (doc, lo, dq, n, gram, whole)))
        if len(hot):
            yield _split(by_doc(hot), 2, *(x[hot] for x in (doc, lo, dq, n, gram)))
            yield _split(own(marks), -1, marks)
        if len(rest):
            yield _split(by_doc(rest), 0, doc[rest], lo[rest], n[rest])

    for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, lo, dq, n, gram, whole in runs(*utf8(batch.column("text")), p):
            held.append((ids[row], lo.astype(np.uint32), dq.astype(np.uint8), n.astype(np.uint8), gram, whole))
            count += len(row)
            if count >= p.flush:
                yield from send()
                count = 0
    if held:
        yield from send()


_FOUND = "kind int, doc_id long, lo long, dq int, n int, key long"


def _rows(kind: int, doc: np.ndarray, lo: np.ndarray, dq: np.ndarray, n: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(doc), 100_000):
        s = slice(a, a + 100_000)
        m = len(doc[s])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(doc[s].astype(np.int64)), pa.array(lo[s].astype(np.int64)), pa.array(dq[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), pa.array(key[s].astype(np.uint64).view(np.int64))], names=["kind", "doc_id", "lo", "dq", "n", "key"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[list[np.ndarray]]]]:
    """Blobs of one part after another (the rows come sorted by part and kind): part, kind and shards."""
    part, kind, shards = None, None, []
    for batch in batches:
        for x, k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (x, k) != (part, kind):
                if shards:
                    yield part, kind, shards
                part, kind, shards = x, k, []
            shards.append(_unpack(blob))
    if shards:
        yield part, kind, shards


def _meet(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    """Runs of equal anchor: kind 0 covered; 1 to be settled; 2 the same, of a hot anchor."""
    marked: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for part, kind, shards in _by_part(batches):
        if kind < 0:
            marked = (part, np.unique(np.concatenate([g for (g,) in shards])))
            continue
        if kind == 0:
            for doc, lo, n in shards:
                yield from _rows(0, doc, lo, np.zeros(len(doc)), n, np.zeros(len(doc)))
            continue
        if kind == 2:
            for shard in shards:
                yield from _rows(2, *shard)
            continue
        doc, lo, dq, n, gram, whole = (np.concatenate(x) for x in zip(*shards, strict=True))
        order, new, _ = _later(gram, whole, doc=doc, lo=lo)
        rest, rep = order[~new], order[new]
        yield from _rows(0, doc[rest], lo[rest], dq[rest], n[rest], gram[rest])
        _, group = np.unique(gram[rep], return_inverse=True)
        size = np.bincount(group)[group]
        hot = (size > p.hot) | (np.isin(gram[rep], marked[1]) if marked[0] == part else False)
        for kind, pick in ((1, (size > 1) & ~hot), (2, hot)):
            r = rep[pick]
            yield from _rows(kind, doc[r], lo[r], dq[r], n[r], gram[r])


def _contexts(batches: Iterator[pa.RecordBatch], p: Repeats, parts: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs to be settled, packed by part."""
    held: list[tuple] = []
    size = 0

    def send() -> pa.RecordBatch:
        key, doc, lo, n = (np.array(x, t) for x, t in zip(list(zip(*held, strict=True))[:4], (np.uint64, np.int64, np.int64, np.int64), strict=True))
        text = [h[4] for h in held]
        part = (mix64(key) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            o = order[a:b]
            out.append((int(part[o[0]]), 1, _pack(doc[o], lo[o], n[o], np.frombuffer(b"".join(text[i] for i in o), np.uint8))))
        return _blobs(out)

    seen: dict[tuple[int, bytes], int] = {}  # blocks of hot anchors that this shard holds already
    early: list[tuple[int, int, int]] = []
    for batch in batches:
        for doc, text, todo in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("todo"), strict=True):
            raw = text.as_buffer()
            t = todo.values.flatten()
            for lo, dq, n, key, kind in zip(*(x.to_pylist() for x in t), strict=True):
                if kind == 1:
                    held.append((key & (2**64 - 1), doc, lo, n, bytes(raw[lo : lo + n + p.length - 1])))
                    size += n + p.length
                    continue
                for a in range(lo, lo + n):  # a hot anchor: blocks of windows at fixed places from the anchor
                    i, w = lo + dq - a, p.hot_windows
                    if a > lo and (i + 1) % w:
                        continue
                    m = min(lo + n - a, i % w + 1)
                    own = bytes(raw[a : a + m + p.length - 1])
                    core = own[i % w : i % w - w + 1 + p.length]  # what all windows of this block hold
                    shared = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=str(i // w).encode()).digest(), "little")
                    before = seen.get((shared, own))
                    if before is None:
                        seen[shared, own] = len(held)
                        held.append((shared, doc, a, m, own))
                        size += m + p.length
                    elif (held[before][1], held[before][2]) <= (doc, a):
                        early.append((doc, a, m))
                    else:
                        early.append(held[before][1:4])
                        held[before] = (shared, doc, a, m, own)
            if size >= 8 << 20:
                yield send()
                held, size, seen = [], 0, {}
            if len(early) >= 100_000:
                yield _early(early, parts)
                early = []
    if held:
        yield send()
    if early:
        yield _early(early, parts)


def _early(rows: list[tuple[int, int, int]], parts: int) -> pa.RecordBatch:
    doc, lo, n = np.array(rows, np.int64).T
    return _split((mix64(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int32), 0, doc, lo, n)


class ShardBwt:
    """Burrows-Wheeler transform of a shard's symbol strings: suffixes in order and the symbol before each.

    `codes[i]` is the symbol at suffix i, `follow[i]` the suffix one symbol on (-1: the string ends);
    suffixes are ordered by their first `depth` symbols.
    """

    def __init__(self, codes: np.ndarray, follow: np.ndarray, depth: int):
        keys, at = [], np.arange(len(codes))
        for _ in range(depth):
            keys.append(np.where(at >= 0, codes[at], -1))
            at = np.where(at >= 0, follow[at], -1)
        self.order = np.lexsort(keys[::-1])
        before = np.full(len(codes), -1, np.int64)
        has = follow >= 0
        before[follow[has]] = np.flatnonzero(has)
        self.before = before[self.order]  # the suffix one symbol longer, -1: none
        self.symbols = np.where(self.before >= 0, codes[self.before], -1)


def merge_bwts(shards: list[ShardBwt], tails: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes, correct to `depth` symbols, and the length of each common prefix.

    Returns for each place: its shard, its place in that shard's order, and the common prefix with the
    place before in symbols (`depth` stands for that many or more).
    """
    n = sum(len(s.order) for s in shards)
    z = np.repeat(np.arange(len(shards)), [len(s.order) for s in shards])  # round 0: one shard after another
    common = np.full(n, depth, np.int64)
    block = np.zeros(n, np.int64)  # which suffixes agree so far
    base = np.concatenate([[0], np.cumsum([len(s.order) for s in shards])])
    symbols = np.concatenate([s.symbols for s in shards]) if n else np.zeros(0, np.int64)
    # `tails`: symbols of suffixes of one symbol; no entry comes before them, and they lead their bucket
    tails = [np.sort(t) for t in tails]
    tail_code = np.concatenate(tails) if tails else np.zeros(0, np.int64)
    tail_shard = np.repeat(np.arange(len(tails)), [len(t) for t in tails])
    for t in range(1, depth + 1):
        place = np.empty(n, np.int64)
        by_shard = np.argsort(z, kind="stable")
        place[by_shard] = np.arange(n)  # the interleave takes each shard's entries in their order
        c = symbols[place]
        has = np.flatnonzero(c >= 0)
        # deal: bucket by symbol; string ends first, then the walk's order
        code = np.concatenate([tail_code, c[has]])
        shard = np.concatenate([tail_shard, z[has]])
        # what follows a tail is the empty string: like all else before the first symbol, alone after it
        old = np.concatenate([np.full(len(tail_code), 0 if t == 1 else -1), block[has]])
        order = np.argsort(code, kind="stable")
        z, code, old = shard[order], code[order], old[order]
        new = np.ones(n, bool)
        new[1:] = (code[1:] != code[:-1]) | (old[1:] != old[:-1])
        common[new & (common == depth)] = t - 1
        block = np.cumsum(new) - 1
    by_shard = np.argsort(z, kind="stable")
    place = np.empty(n, np.int64)
    place[by_shard] = np.arange(n)
    return z, place - base[z], common


def settle(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows that start earlier elsewhere, from shards of (doc, lo, windows, bytes)."""
    s, depth = p.symbol, p.length // p.symbol
    prepared, every = [], []
    for doc, lo, n, data in shards:
        size = n + p.length - 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        # suffixes at window starts and whole symbols after them
        use = np.minimum(n + p.length - s, size - s + 1)
        item = np.repeat(np.arange(len(n)), use)
        off = np.arange(len(item)) - np.repeat(np.cumsum(use) - use, use)
        few = (off % s < n[item]) | (n[item] >= s)
        item, off = item[few], off[few]
        sums, down = _sums(data)
        pos = start[item] + off
        symbol = mix64((sums[pos + s] - sums[pos]) * down[pos])
        index = np.full(len(data), -1, np.int64)
        index[pos] = np.arange(len(pos))
        follow = np.where(off + 2 * s <= size[item], index[np.minimum(pos + s, len(data) - 1)], -1)
        prepared.append((doc, lo, n, item, off, follow))
        every.append(symbol)
    if not every:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, ranks = np.unique(np.concatenate(every), return_inverse=True)
    cuts = np.cumsum([0, *(len(e) for e in every)])
    bwts, tails = [], []
    for i, (_, _, _, _, _, follow) in enumerate(prepared):
        codes = ranks[cuts[i] : cuts[i + 1]]
        bwts.append(ShardBwt(codes, follow, depth))
        tails.append(codes[follow < 0])
    z, place, common = merge_bwts(bwts, tails, depth)
    base = cuts[:-1]
    suffix = np.concatenate([b.order for b in bwts])[base[z] + place] + base[z]
    doc = np.concatenate([d[i] for d, _, _, i, _, _ in prepared])
    at = np.concatenate([lo[i] + o for _, lo, _, i, o, _ in prepared])
    window = np.concatenate([o < n[i] for _, _, n, i, o, _ in prepared])
    interval = np.cumsum(common < depth)
    ok = window[suffix]
    suffix, interval = suffix[ok], interval[ok]
    order, new, _ = _later(interval, doc=doc[suffix], lo=at[suffix])
    hit = suffix[order[~new]]
    return doc[hit], at[hit]


def _joined(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring window starts as runs (doc, first, count)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    doc, at = doc[keep], at[keep]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])) if len(doc) else np.zeros(0, int)
    return doc[new], at[new], np.diff(np.append(new, len(doc)))


def _settled(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    for _, kind, shards in _by_part(batches):
        if kind == 0:
            doc, lo, n = (np.concatenate(x) for x in zip(*shards, strict=True))
        else:
            doc, lo, n = _joined(*settle(shards, p))
        yield from _rows(0, doc, lo, np.zeros(len(doc)), n, np.zeros(len(doc)))


def covered(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, lo, n): runs of starts of `length`-byte strings that start earlier too. Needs unique ids."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("text is not null and octet_length(text) >= %d" % p.length)
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    parts = max(64, -(-total // (p.shard_mb << 20)))
    # with few flushes an anchor's task can take more of each: about `hot` runs in all
    many = max(p.hot_here, p.hot * p.flush * 35 // max(1, total))
    sent = docs.mapInArrow(lean(lambda it: _shard(it, p, parts, many), "repeats"), _BLOBS).repartition(parts, "part").sortWithinPartitions("part", "kind")
    met = written(sent.mapInArrow(lean(lambda it: _meet(it, p), "repeats"), _FOUND), "repeats-runs")
    del sent
    free_shuffles(spark)
    open_runs = met.where("kind > 0")
    size = int(open_runs.agg(F.coalesce(F.sum(F.col("n") + p.length), F.lit(0))).first()[0])
    parts2, tasks2 = max(64, -(-size // p.merge_bytes)), max(64, -(-size // p.task_bytes))
    todo = open_runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "dq", "n", "key", "kind")).alias("todo"))
    texts = docs.join(todo, "doc_id").select("doc_id", "text", "todo").mapInArrow(lean(lambda it: _contexts(it, p, parts2), "repeats"), _BLOBS)
    late = written(texts.repartition(tasks2, "part").sortWithinPartitions("part", "kind").mapInArrow(lean(lambda it: _settled(it, p), "repeats"), _FOUND), "repeats-settled")
    del texts, todo
    free_shuffles(spark)
    return met.where("kind = 0").select("doc_id", "lo", "n").unionByName(late.select("doc_id", "lo", "n"))


def spans_of(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed runs (first byte, end) from runs of window starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + counts - 1 + length)[order]
    b = np.maximum.accumulate(b)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return np.stack([a[new], np.append(b[new[1:] - 1], b[-1])], axis=1)


def _cut(raw: bytes, cuts, length: int) -> tuple[bytes, int, int]:
    if cuts is None:
        return raw, 0, 0
    lo, n = cuts.values.flatten()
    spans = spans_of(lo.to_numpy(), n.to_numpy().astype(np.int64), length)
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), int((spans[:, 1] - spans[:, 0]).sum()), len(spans)


def _digest(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
            raw = (text.as_py() or "").encode()
            kept, removed, n = _cut(raw, cuts if cuts.is_valid else None, length)
            out.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(batches: Iterator[pa.RecordBatch], length: int, cuts_column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch.column("text"), batch.column(cuts_column), strict=True):
            out.append(text.as_py() if not cuts.is_valid else _cut((text.as_py() or "").encode(), cuts, length)[0].decode(errors="ignore"))
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.string())).drop_columns([cuts_column])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a unique integer key in document order: doc_id itself unless ids repeat or are null."""
    n, known, some = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == some:
        return docs, "doc_id"
    key = fresh(docs, "key")
    return written(docs.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "repeats-keyed"), key


def _with_cuts(docs: DataFrame, p: Repeats) -> tuple[DataFrame, str]:
    """The rows, and the name of a new column that holds each one's runs of window starts."""
    keyed, key = _keyed(docs)
    found = covered(keyed.select(F.col(key).cast("long").alias("doc_id"), "text"), p)
    doc, name = fresh(keyed, "doc"), fresh(keyed, "cuts")
    cuts = found.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("lo", "n")).alias(name))
    joined = keyed.join(cuts, F.col(key).cast("long") == F.col(doc), "left")
    return joined.select(*(F.col(f"`{c}`") for c in (*docs.columns, name))), name


def repeat_digests(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    joined, _ = _with_cuts(docs.select("doc_id", "text"), p)  # the new column is "cuts"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "cuts").mapInArrow(lean(lambda it: _digest(it, p.length)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """The input's rows and columns, repeated strings cut from `text` (a character cut in half goes)."""
    joined, name = _with_cuts(docs, p)
    return joined.mapInArrow(lean(lambda it: _kept(it, p.length, name)), docs.schema)
