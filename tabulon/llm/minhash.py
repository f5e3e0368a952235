"""Near-duplicate groups by b-bit MinHash with band candidates and an exact check.

Method
    1. Words are lower-cased (A-Z), cut at ASCII white space; a text's set holds the 64-bit hashes of
       its distinct runs of `shingle` words. Rows with equal sets form a class (128-bit digest of the
       set), of which the smallest id goes on: copies never meet in a bucket.
    2. Per class, `bands * rows` minima. Each band of `rows` minima gives a bucket key; of every
       minimum the low two bits are kept, packed into 64-bit words (b-bit signature).
    3. A bucket's centre is its heaviest member (the one whose buckets hold most members; in a group of
       near copies that is one close to all). A member's centres that the collision-corrected estimate
       from bit counts leaves likely are kept, and the best of them is confirmed on the full sets: a
       large group costs a pair a member.
    4. Links give components (min-label propagation with pointer jumping). In buckets that then hold
       several, members outside the leading component are compared with the bucket's other members, in
       blocks, on finer signatures. Of the likely pairs across components each member's best one for a
       component is confirmed, for a few rounds. If some then have others, members with likely partners go
       to blocks with their full sets, where all these pairs are tested and only links come out: members are
       sent, never pairs. A pair is taken in the bucket of the first band it shares. So no likely pair
       across components of a bucket stays untested.

A pair at the threshold 0.75 shares none of 32 bands of 3 rows with probability (1 - 0.75 ** 3) ** 32
= 2.4e-8, and is refused by the estimate with probability below 1e-7.

Defined results: a null or empty text (or one of white space only) has an empty set, n_shingles 0,
and is its own component; texts shorter than the shingle form one shingle of all their words. Ties
go to the smaller id; repeated (equal) rows fall in one class; a null id is kept as a row of its own
component null and links with nothing. An empty table gives an empty result. Other columns of the
input aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, free_shuffles, lean, mix64, odd_inverse, powers, slices, utf8, written

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = odd_inverse(_BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


@dataclass(frozen=True)
class NearDup:
    """Parameters: words a shingle, similarity as a fraction, bands and rows a band."""

    shingle: int = 5
    num: int = 75
    den: int = 100
    bands: int = 32
    rows: int = 3
    refuse: float = 0.45
    fine: int = 1024
    fine_refuse: float = 0.665
    #: Rounds in which a member meets only the best of each other component of its buckets; then it meets all that are likely.
    rounds: int = 2
    #: Members of a bucket that meet as many others in one go; and where their full sets are at hand.
    block: int = 1024
    exact_block: int = 512


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, in order, and where each text's words begin (n + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INV, len(data))[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix64(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offs)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(*utf8(column))
    if len(words) >= k:
        n = len(words) - k + 1
        runs = words[:n].copy()
        for j in range(1, k):
            runs = mix64(runs * np.uint64(_BASE) + words[j : j + n])
    else:
        runs = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in words[a:b]:
                x = mix64(x * np.uint64(3) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return (rng.integers(0, 2**32, n, np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 2**32, n, np.uint64).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, block by block."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        np.minimum(low, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=low)
    return low


def _packed(mins: np.ndarray) -> np.ndarray:
    """The low two bits of each (mixed) minimum, 32 in a word."""
    n, k = mins.shape
    pad = np.zeros((n, -(-k // 32) * 32), np.uint64)
    pad[:, :k] = mix64(mins.astype(np.uint64)) & np.uint64(3)
    return np.bitwise_or.reduce(pad.reshape(n, -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def _lists(x: np.ndarray) -> pa.Array:
    n, w = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))


def _band_keys(mins: np.ndarray, p: NearDup) -> np.ndarray:
    """A bucket key from each band of minima."""
    m64 = mins.astype(np.uint64).reshape(len(mins), p.bands, p.rows)
    keys = np.full((len(mins), p.bands), 7, np.uint64) + np.arange(p.bands, dtype=np.uint64) * np.uint64(_BASE)
    for r in range(p.rows):
        keys = mix64(keys * np.uint64(_BASE) + m64[:, :, r])
    return keys


def _minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    a, b = _families(k)
    return np.stack([minima(s, a, b) for s in sets]) if sets else np.zeros((0, k), np.uint32)


def _sign(batches: Iterator[pa.RecordBatch], p: NearDup) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"), p.shingle)
            mins = _minima(sets, p.bands * p.rows)
            digest = np.array([(np.bitwise_xor.reduce(mix64(s)), np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5)))) if len(s) else (0, 0) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy().view(np.int64)), pa.array(digest[:, 1].copy().view(np.int64)), _lists(_packed(mins)), _lists(_band_keys(mins, p))],
                names=["doc_id", "n_shingles", "d0", "d1", "sig", "bands"],
            )


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(lean(lambda it: _sign(it, p)), "doc_id long, n_shingles long, d0 long, d1 long, sig array<long>, bands array<long>")


_SETS = "doc_id long, n long, set binary, fine array<long>"


def _sets(batches: Iterator[pa.RecordBatch], p: NearDup) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"), p.shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), _lists(_packed(_minima(sets, p.fine)))],
                names=["doc_id", "n", "set", "fine"],
            )


def _close(s: np.ndarray, t: np.ndarray, p: NearDup) -> bool:
    """Exact test of den * |S & T| >= num * |S | T| on sorted sets."""
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and p.den * common >= p.num * (len(both) - common)


def _confirm(batches: Iterator[pa.RecordBatch], p: NearDup) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are close."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            keep.append(_close(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p))
        out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        if out.num_rows:
            yield out


def corrected(k: int, x: str, y: str):
    """Similarity estimate from two packed signatures of k minima: matching two-bit fields, less chance matches of one in four."""
    words = -(-k // 32)
    fields = F.lit(0)
    for i in range(words):
        same = F.bitwise_not(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
        both = same.bitwiseAND(F.shiftrightunsigned(same, 1)).bitwiseAND(F.lit(0x5555555555555555))
        fields = fields + F.bit_count(both)
    return ((fields - F.lit(words * 32 - k)) / F.lit(float(k)) - 0.25) / 0.75


def _sized(p: NearDup, x: str = "n_a", y: str = "n_b"):
    return F.least(x, y) * p.den >= F.greatest(x, y) * p.num


def _links(sets: DataFrame, pairs: DataFrame, p: NearDup, name: str) -> DataFrame:
    """Pairs (a, b) confirmed on full sets. Merge joins at every size: sets are the large side."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"set_{x}")).hint("merge")
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return written(joined.select("a", "b", "set_a", "set_b").mapInArrow(lean(lambda it: _confirm(it, p)), "a long, b long"), name)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the least node of each component of a batch: what is linked stays linked, by fewer and shallower edges."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        x, y = at[: batch.num_rows], at[batch.num_rows :]
        root = np.arange(len(ids))
        while True:  # labels go down along edges and along themselves until nothing moves
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        deep = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[deep]]), pa.array(ids[deep])], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc_id, component) of every node of `links` (a, b): least id reachable.

    Batches of links become forests first. Then each round takes the least label among neighbours (partial
    minima before the shuffle) and the label's own label. Ends when nothing changes.
    """
    near = links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    edges = written(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("doc_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "doc_id", "left").select("doc_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("c"))
        up = labels.select(F.col("doc_id").alias("c"), F.col("component").alias("up"))
        jumped = written(lower.join(up, "c", "left").select("doc_id", "old", F.least("c", F.coalesce("up", "c")).alias("component")), "cc-labels")
        changed = not jumped.where(F.col("old") != F.col("component")).isEmpty()
        drop_written(labels)
        labels = jumped.select("doc_id", "component")
        if not changed:
            break
    else:
        raise RuntimeError("components: labels still change; raise most_rounds")
    drop_written(edges)
    return labels


# --- buckets that hold several components ---


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, doc_id) of buckets that hold several components, with `component`, the bucket's `lead` (its largest component), its rows `m_all` and those outside the lead, `m_out`."""
    own = rows.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("w")).groupBy("key")
    lead = sizes.agg(F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("m_all")).where(F.col("m_all") > F.col("top.w"))
    return own.join(lead.select("key", F.col("top.component").alias("lead"), "m_all", (F.col("m_all") - F.col("top.w")).alias("m_out")).hint("merge"), "key")


def _blocks(tagged: DataFrame, sets: DataFrame, block: int, carry: list[str]) -> DataFrame:
    """Open buckets, dealt in blocks of their members outside the lead against blocks of all members, with the carried columns of `sets`."""
    rows = tagged.join(sets.select("doc_id", *carry).hint("merge"), "doc_id")
    count = lambda m: F.ceil(F.col(m) / F.lit(block)).cast("int")
    own = lambda m, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), count(m)).cast("int")
    others = lambda m: F.explode(F.sequence(F.lit(0), count(m) - 1))
    rest = ["doc_id", "component", "lead", *carry]
    out = rows.where("component <> lead").select("key", own("m_out", 1).alias("ob"), others("m_all").alias("ib"), F.lit(True).alias("outside"), *rest)
    within = rows.select("key", others("m_out").alias("ob"), own("m_all", 2).alias("ib"), F.lit(False).alias("outside"), *rest)
    return out.unionByName(within).repartition("key", "ob", "ib").sortWithinPartitions("key", "ob", "ib")


def _each_block(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """What `of` makes of each block (a table) of a partition sorted by (key, ob, ib)."""
    held: list[pa.RecordBatch] = []

    def settle() -> Iterator[pa.RecordBatch]:
        if held and (got := of(pa.Table.from_batches(held))) is not None:
            yield got

    now = None
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "ob", "ib")])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if e > s:
                if (key := tuple(ids[:, s])) != now:
                    yield from settle()
                    held.clear()
                    now = key
                held.append(batch.slice(s, e - s))
    yield from settle()


def _likely(block: pa.Table, p: NearDup) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of likely partners across components, outside members first, and the pairs' estimates; some outside members at a time."""
    col = {c: block.column(c).to_numpy() for c in ("outside", "doc_id", "component", "lead", "n")}
    sig = block.column("fine").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(block.num_rows, -1)
    o, i = np.flatnonzero(col["outside"]), np.flatnonzero(~col["outside"])
    step = max(1, (8 << 20) // max(1, len(i) * sig.shape[1] * 8))
    for c in range(0, len(o), step):
        x = o[c : c + step]
        same = ~(sig[x][:, None, :] ^ sig[i][None, :, :])
        same &= same >> np.uint64(1)
        same &= np.uint64(0x5555555555555555)
        est = ((np.bitwise_count(same).sum(axis=2, dtype=np.int64) - (sig.shape[1] * 32 - p.fine)) / p.fine - 0.25) / 0.75
        a, b = col["doc_id"][x][:, None], col["doc_id"][i][None, :]
        ca, cb = col["component"][x][:, None], col["component"][i][None, :]
        na, nb = col["n"][x][:, None], col["n"][i][None, :]
        ok = (est >= p.fine_refuse) & (ca != cb) & ((cb == col["lead"][i][None, :]) | (a < b)) & (np.minimum(na, nb) * p.den >= np.maximum(na, nb) * p.num)
        u, v = np.nonzero(ok)
        if len(u):
            yield x[u], i[v], est[u, v]


def _cross(batches: Iterator[pa.RecordBatch], p: NearDup) -> Iterator[pa.RecordBatch]:
    """A member's likeliest partner in each other component of a block (`more`: it has others there)."""

    def found(block: pa.Table) -> pa.RecordBatch | None:
        ids, component, out = block.column("doc_id").to_numpy(), block.column("component").to_numpy(), []
        for u, v, est in _likely(block, p):
            order = np.lexsort((ids[v], -est, component[v], u))
            u, v = u[order], v[order]
            first = np.ones(len(u), bool)
            first[1:] = (u[1:] != u[:-1]) | (component[v][1:] != component[v][:-1])
            more = first & ~np.append(first[1:], True)
            out.append((ids[u[first]], ids[v[first]], more[first]))
        if not out:
            return None
        a, b, more = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], names=["a", "b", "more"])

    yield from _each_block(batches, found)


def _shared_first(block: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Pairs of rows whose first shared band is this block's bucket."""
    bands, key = block.column("bands").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1), block.column("key")[0].as_py()
    first = (bands[u] == bands[v]).argmax(axis=1)
    return bands[u, first] == key


def _wanted(batches: Iterator[pa.RecordBatch], p: NearDup) -> Iterator[pa.RecordBatch]:
    """Members of a block with a likely partner there, for pairs that this bucket is to test."""

    def found(block: pa.Table) -> pa.RecordBatch | None:
        rows = [np.unique(np.concatenate([u[mine], v[mine]])) for u, v, _ in _likely(block, p) if (mine := _shared_first(block, u, v)).any()]
        if not rows:
            return None
        t = block.take(pa.array(np.unique(np.concatenate(rows)))).combine_chunks()
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("key", "doc_id", "component", "lead")], names=["key", "doc_id", "component", "lead"])

    yield from _each_block(batches, found)


def _tested(batches: Iterator[pa.RecordBatch], p: NearDup) -> Iterator[pa.RecordBatch]:
    """Links of a block, found on full sets: one for a member and another component is enough."""

    def found(block: pa.Table) -> pa.RecordBatch | None:
        ids, component, full, out = block.column("doc_id").to_numpy(), block.column("component").to_numpy(), block.column("set"), []
        for u, v, est in _likely(block, p):
            mine = _shared_first(block, u, v)
            u, v, est = u[mine], v[mine], est[mine]
            done: set[tuple[int, int]] = set()
            for k in np.lexsort((-est, u)).tolist():
                x, y = int(u[k]), int(v[k])
                if (x, int(component[y])) in done:
                    continue
                s, t = (np.frombuffer(full[r].as_buffer(), np.uint64) for r in (x, y))
                if _close(s, t, p):
                    done.add((x, int(component[y])))
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"]) if out else None

    yield from _each_block(batches, found)


def _last_links(still: DataFrame, labels: DataFrame, sets: DataFrame, bands: DataFrame, p: NearDup) -> DataFrame:
    """Links among all likely pairs across components of open buckets: members with such a pair meet with their full sets."""
    banded = written(sets.select("doc_id", "n", "fine").join(bands.hint("merge"), "doc_id"), "neardup-bands")
    wanted = _blocks(_open(still, labels), banded, p.block, ["n", "fine", "bands"]).mapInArrow(lean(lambda it: _wanted(it, p)), "key long, doc_id long, component long, lead long")
    wanted = written(wanted.distinct(), "neardup-wanted")
    sizes = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("m_all"), F.count_if(F.col("component") != F.col("lead")).alias("m_out"))
    full = sets.join(banded.select("doc_id", "bands").hint("merge"), "doc_id")
    blocks = _blocks(wanted.join(sizes.hint("merge"), "key"), full, p.exact_block, ["n", "fine", "bands", "set"])
    return written(blocks.mapInArrow(lean(lambda it: _tested(it, p)), "a long, b long").distinct(), "neardup-links")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module's text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sigs = written(signatures(docs, p), "neardup-sig")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = written(full.groupBy("d0", "d1", "n_shingles").agg(F.min("doc_id").alias("class_id")), "neardup-classes")
    firsts = reps.select(F.col("class_id").alias("doc_id")).hint("merge")
    keyed = full.select("doc_id", "bands").join(firsts, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key"))
    # buckets of two documents or more; equal (key, doc_id) rows of a repeated id fall together
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
    buckets = keyed.join(shared.hint("merge"), "key").groupBy("doc_id").agg(F.collect_set(F.struct("key", "m")).alias("buckets"))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda t, b: t + b["m"])
    members = buckets.join(full.select("doc_id", F.col("n_shingles").alias("n"), "sig").hint("merge"), "doc_id").select("doc_id", "n", "sig", "buckets", F.struct(weight.alias("w"), F.xxhash64("doc_id").alias("h"), "doc_id").alias("rank"))
    members = written(members, "neardup-members")
    free_shuffles(spark)
    rows = members.select("doc_id", "n", "sig", "rank", F.explode("buckets").alias("k")).select("doc_id", "n", "sig", "rank", "k.key", "k.m")
    # each bucket's centre is its heaviest member; what a member's centres leave likely, and of that its best
    centres = rows.groupBy("key").agg(F.max_by(F.struct(F.col("doc_id").alias("c"), F.col("n").alias("n_c"), F.col("sig").alias("sig_c")), "rank").alias("x")).select("key", "x.*")
    near = corrected(p.bands * p.rows, "sig", "sig_c")
    stars = rows.join(centres.hint("merge"), "key").where((F.col("doc_id") != F.col("c")) & _sized(p, "n", "n_c")).withColumn("near", near).where(F.col("near") >= p.refuse)
    stars = written(stars.select("key", "doc_id", "c", "near", "m"), "neardup-stars")
    best = stars.groupBy("doc_id").agg(F.max_by("c", F.struct("near", "c")).alias("c"))
    pairs = written(best.select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b")), "neardup-pairs")
    twos = stars.where("m = 2").select("key", F.explode(F.array("doc_id", "c")).alias("doc_id"))
    still = written(rows.where("m > 2").select("key", "doc_id").unionByName(twos), "neardup-open")
    needed = still.select("doc_id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    sets = written(docs.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(lean(lambda it: _sets(it, p)), _SETS), "neardup-sets")
    free_shuffles(spark)
    links = _links(sets, pairs, p, "neardup-links")
    tested, labels, more = pairs, components(links), True
    # likely pairs across components of a bucket: a member's best ones, for a few rounds; what then is left, whole.
    # `more` is read before tested pairs go: a member whose best one was refused may still have others.
    for _ in range(p.rounds):
        likely = _blocks(_open(still, labels), sets, p.block, ["n", "fine"]).mapInArrow(lean(lambda it: _cross(it, p)), "a long, b long, more boolean")
        likely = written(likely.groupBy("a", "b").agg(F.max("more").alias("more")), "neardup-likely")
        more = likely.agg(F.max("more")).first()[0]
        new = written(likely.select("a", "b").join(tested.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "neardup-new")
        free_shuffles(spark)
        none = new.isEmpty()
        if not none:
            found = _links(sets, new, p, "neardup-links")
            if not found.isEmpty():
                links = links.unionByName(found)
                labels = components(links)
            tested = tested.unionByName(new)
        drop_written(likely)
        if none or not more:
            break
    if more:
        bands = full.select("doc_id", "bands").join(needed.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("bands").alias("bands"))
        found = _last_links(still, labels, sets, bands, p)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    drop_written(members, stars, pairs, still, sets, links, tested)
    classes = reps.join(labels.select(F.col("doc_id").alias("class_id"), F.col("component").alias("component_id")), "class_id", "left").select("d0", "d1", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "d0", "d1").join(classes.hint("merge"), ["d0", "d1", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
