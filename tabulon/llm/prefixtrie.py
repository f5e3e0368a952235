"""Prefix trie of conversations: MSD radix partitioning over turn ids, multikey quicksort in local buckets.

Method
    1. Turns (role, text) become 64-bit ids. The dictionary is checked: ids that two different turns share
       (found by an aggregate of their SHA-256) are given anew. Text goes no further.
    2. Turns are numbered in their conversation by ranges over the whole table, so a conversation that holds
       a third of all turns is many ranges. Conversations are rebuilt, and cut in rows of at most `segment`
       turns. Equal rows become one with a count, the least conversation and the digest of those that end there.
    3. A bucket is the set of rows that share a beginning. Buckets of more than `local_rows` rows are split by the
       next id; each round emits the nodes that it splits off. Buckets of fewer rows are local: a task sorts each
       by three-way quicksort on the next id, and emits a node whenever a part of equal ids goes one deeper.
    4. Totals of subtrees go up: inside local buckets by the tasks, then from level to level of the rounds,
       then from the segments of long conversations to the ones before them.

Ids of the conversations that end in a node are joined in blocks of `id_block` ids each; SHA-256 of a node
with several blocks is taken by one task that streams the blocks in order, holding one at a time (the digest
can only be taken in order). A row (of at most `segment` turns, 12 bytes each) and `local_rows` rows are what
a task holds at most. Rounds are as many as beginnings are deep that more than `local_rows` different
conversations share.

Defined results: rows are ordered by turn (null first), ties by turn id, so repeated rows all count; null role or text is
empty; rows of null conversation belong to none and are left out. The base of a negative number is
the one towards zero. An empty table gives an empty result (no root). Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, small, written

NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    #: Conversations that share a base, and the number that the turns taken from it stay below.
    family: int = 100
    heads: int = 6
    #: Turns that a row holds at most.
    segment: int = 4096
    #: Different rows that a local bucket holds at most.
    local_rows: int = 2000
    id_block: int = 4096
    #: Rows up to which split buckets are broadcast.
    few: int = 100_000


# --- turns as numbers ---


def coded(conversations: DataFrame, p: Trie = Trie(), hashing=F.xxhash64) -> DataFrame:
    """(conv_id, turn, code, chars): turns as ids of their dictionary; different turns have different ids."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", hashing(role, text).alias("code"), F.length(text).alias("chars"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha")
    )
    turns = written(turns, "trie-turns")
    salt = 0
    while True:
        twice = written(turns.groupBy("code").agg(F.min("sha").alias("a"), F.max("sha").alias("z")).where("a <> z").select(F.col("code").alias("twice")), "trie-twice")
        if twice.isEmpty():
            return turns.drop("sha")
        salt += 1
        again = F.when(F.col("twice").isNotNull(), F.xxhash64(F.lit(salt), "sha")).otherwise(F.col("code"))
        turns = written(turns.join(small(twice, p.few), F.col("code") == F.col("twice"), "left").withColumn("code", again).drop("twice"), "trie-turns")


def dictionary(conversations: DataFrame) -> DataFrame:
    """(role, text, n): the different turns and how often they occur."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    return conversations.select(role, text).groupBy("role", "text").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(turns: DataFrame, p: Trie = Trie()) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations' turns (conv_id, depth from 0, code, chars), and (conv_id, n) of all of them, turnless ones too."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(p.heads)).cast("int")
    turns = placed(turns, ["turn", "code"], "at", by=("conv_id",))
    one = F.struct("at", "code", "chars")
    every = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.array_sort(F.collect_list(F.when(F.col("at") < p.heads - 1, one))).alias("head"))
    every = written(every, "trie-conversations")
    bases = every.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plan = every.withColumn("h", h).join(bases, F.col("base") == F.col("conv_id") - F.col("conv_id") % p.family, "left")
    taken = F.slice(F.coalesce("base_head", F.array().cast(bases.schema["base_head"].dataType)), F.lit(1), F.col("h"))
    plan = written(plan.select("conv_id", "h", taken.alias("taken"), (F.size(taken) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n")), "trie-plan")
    lead = plan.select("conv_id", F.posexplode("taken").alias("depth", "x")).select("conv_id", F.col("depth").cast("long").alias("depth"), "x.code", "x.chars")
    own = turns.join(plan.select("conv_id", "h", F.size("taken").alias("got")), "conv_id").where(F.col("at") >= F.col("h"))
    return lead.unionByName(own.select("conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("depth"), "code", "chars")), plan.select("conv_id", "n")


def segments(turns: DataFrame, every: DataFrame, p: Trie) -> DataFrame:
    """(conv_id, k, bucket, next, codes, chars): rows of at most `segment` turns; the last one is never full (it may be empty).

    `bucket` stands for all that comes before the row, `next` for that and the row.
    """
    k = F.floor(F.col("depth") / p.segment).cast("int")
    rows = turns.groupBy("conv_id", k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("depth", "code", "chars"))).alias("x")).select("conv_id", "k", F.col("x.code").alias("codes"), F.col("x.chars").alias("chars"))
    none = every.where(F.col("n") % p.segment == 0).select("conv_id", F.floor(F.col("n") / p.segment).cast("int").alias("k"), F.array().cast("array<long>").alias("codes"), F.array().cast("array<int>").alias("chars"))
    rows = written(rows.unionByName(none).withColumn("seg", F.md5(F.array_join(F.col("codes").cast("array<string>"), ",").cast("binary"))), "trie-segments")
    long = every.where(F.col("n") >= p.segment).select("conv_id")
    step = lambda done, s: F.concat(done, F.array(F.md5(F.concat(F.element_at(done, -1), s["seg"]).cast("binary"))))
    chain = rows.join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "seg"))).alias("all"))  # 16 bytes for `segment` turns
    chain = chain.select("conv_id", F.posexplode(F.aggregate("all", F.array(F.lit("")), step)).alias("k", "bucket"))
    out = rows.join(chain, ["conv_id", "k"], "left").withColumn("bucket", F.coalesce("bucket", F.lit("")))
    following = F.when(F.size("codes") == p.segment, F.md5(F.concat("bucket", "seg").cast("binary")))
    return out.withColumn("next", following)


# --- digests of the conversations that end in a node ---


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's blocks in order; one block is held at a time."""
    now, sha, first = None, None, True
    done: list[tuple[str, str, str]] = []
    for batch in batches:
        for bucket, seg, ids in zip(*(batch.column(c) for c in ("bucket", "seg", "ids")), strict=True):
            key = (bucket.as_py(), seg.as_py())
            if key != now:
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha, first = key, hashlib.sha256(), True
            if not first:
                sha.update(b",")
            sha.update(ids.as_buffer())
            first = False
    if now is not None:
        done.append((*now, sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["bucket", "seg", "ends"])


def endings(rows: DataFrame, p: Trie) -> DataFrame:
    """(bucket, seg, ends): digest of the conversations that end with this row."""
    blocks = rows.groupBy("bucket", "seg", F.floor(F.col("conv_id") / p.id_block).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    blocks = written(blocks, "trie-endings")
    groups = blocks.groupBy("bucket", "seg").agg(F.count(F.lit(1)).alias("m"), F.first("ids").alias("ids"))
    single = groups.where("m = 1").select("bucket", "seg", F.sha2("ids", 256).alias("ends"))
    several = blocks.join(groups.where("m > 1").select("bucket", "seg"), ["bucket", "seg"], "left_semi").select("bucket", "seg", "block", "ids")
    streamed = several.repartition("bucket", "seg").sortWithinPartitions("bucket", "seg", "block").mapInArrow(_streamed, "bucket string, seg string, ends string")
    return single.unionByName(streamed)


# --- local buckets ---

_LOCAL = "key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
_ROW = ["key", "at", "codes", "chars", "n", "lo", "ends", "c_children", "c_leaves", "c_saved"]


def sorted_nodes(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | int]]:
    """Trie of different sequences that share their first `at` ids: parent, depth, last row that ends there (-1: none), and members of each node.

    Node 0 is the shared beginning; parents come before children. Multikey quicksort: rows are parted by
    their next id in less, equal and greater than a pivot; equal ones are a node, one deeper.
    """
    room = 1 + int((length - at).sum())
    parent, depth, end = np.full(room, -1), np.full(room, at), np.full(room, -1)
    members: list = [None] * room
    members[0] = np.arange(len(start))
    made, todo = 1, [(members[0], at, 0)]
    while todo:
        rows, d, node = todo.pop()
        stop = length[rows] == d
        if stop.any():
            end[node] = rows[stop][0]
            rows = rows[~stop]
        if len(rows) == 1:  # a row on its own: a chain of nodes
            r = int(rows[0])
            n = int(length[r]) - d
            parent[made] = node
            parent[made + 1 : made + n] = np.arange(made, made + n - 1)
            depth[made : made + n] = np.arange(d + 1, d + n + 1)
            members[made : made + n] = [r] * n
            end[made + n - 1] = r
            made += n
        elif len(rows):
            ids = flat[start[rows] + d]
            pivot = ids[len(ids) // 2]
            for part in (rows[ids < pivot], rows[ids > pivot]):
                if len(part):
                    todo.append((part, d, node))
            same = rows[ids == pivot]
            parent[made], depth[made], members[made] = node, d + 1, same
            todo.append((same, d + 1, made))
            made += 1
    return parent[:made], depth[:made], end[:made], members[:made]


def _bucket(t: pa.Table, above: int) -> pa.RecordBatch:
    """Nodes of a local bucket; its own node, the first one, has its key and only totals (`saved` without its own)."""
    at, key = t.column("at")[0].as_py(), t.column("key")[0].as_py()
    codes, chars = t.column("codes").combine_chunks(), t.column("chars").combine_chunks()
    length = np.array(codes.value_lengths(), np.int64)
    start = np.append(0, np.cumsum(length))[:-1]
    flat, size = codes.flatten().to_numpy(), chars.flatten().to_numpy()
    col = {c: t.column(c).to_numpy() for c in ("n", "lo")}
    beyond = {c: [x or 0 for x in t.column(c).to_pylist()] for c in ("c_children", "c_leaves", "c_saved")}
    ends = t.column("ends").to_pylist()
    parent, depth, end, members = sorted_nodes(flat, start, length, at)
    m = len(parent)
    n_convs = [int(col["n"][x].sum()) for x in members]
    conv = [int(col["lo"][x].min()) for x in members]
    one = [int(x) if isinstance(x, int) else int(x[0]) for x in members]
    children = np.bincount(parent[1:], minlength=m).tolist()
    leaves, saved, digest, up, deep = [0] * m, [0] * m, [NOTHING] * m, parent.tolist(), depth.tolist()
    for i in range(m - 1, -1, -1):
        e = end[i]
        if e >= 0:
            digest[i] = ends[e] or NOTHING
            children[i] += beyond["c_children"][e]
            leaves[i] += beyond["c_leaves"][e] if beyond["c_children"][e] else 0
            saved[i] += beyond["c_saved"][e]
        if not children[i]:
            leaves[i] = 1
        if i:
            saved[i] += (n_convs[i] - 1) * int(size[start[one[i]] + deep[i] - 1])
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    own = [key] + [None] * (m - 1)
    fields = [own, conv, [above + d for d in deep], [None if i == 0 else conv[up[i]] for i in range(m)], n_convs, children, leaves, saved, digest]
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string() if j in (0, 8) else pa.int64()) for j, f in enumerate(fields)], names=[c.split()[0] for c in _LOCAL.split(", ")])


def _local(batches: Iterator[pa.RecordBatch], above: int) -> Iterator[pa.RecordBatch]:
    """Buckets of a sorted partition one by one."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.array(batch.column("key").to_pylist())
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if kept and kept[0].column("key")[0].as_py() != keys[s]:
                yield _bucket(pa.Table.from_batches(kept), above)
                kept = []
            kept.append(batch.slice(s, e - s))
    if kept:
        yield _bucket(pa.Table.from_batches(kept), above)


# --- rounds ---


def _heads(rows: DataFrame, d: int) -> DataFrame:
    """The node of each bucket of rows (key, up, codes, ...) that share their first `d` ids."""
    here = lambda c: F.max(F.when(F.size("codes") == d, F.col(c)))
    last = F.max(F.get("chars", F.lit(d - 1))) if d else F.lit(0)
    return rows.groupBy("key").agg(F.first("up").alias("up"), F.min("lo").alias("conv_id"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("rows"), last.cast("long").alias("last"), *(here(c).alias(c) for c in ("ends", "c_children", "c_leaves", "c_saved")))


def layer(rows: DataFrame, above: int, p: Trie) -> tuple[DataFrame, DataFrame]:
    """Nodes below the buckets of rows (key, codes, chars, n, lo, ends, c_children, c_leaves, c_saved), and the buckets' own nodes (with `key`).

    `above`: depth of the buckets. Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends; `saved` of a bucket's node is without its own.
    """
    active, local, levels, d = rows.withColumn("up", F.lit(None).cast("string")), [], [], 0
    while True:
        levels.append(written(_heads(active, d), "trie-level"))
        big = written(levels[-1].where(F.col("rows") > p.local_rows).select("key"), "trie-split")
        if big.isEmpty():
            local.append(active.withColumn("at", F.lit(d)).select(*_ROW))
            break
        few = small(big, p.few)
        local.append(active.join(few, "key", "left_anti").withColumn("at", F.lit(d)).select(*_ROW))
        digit = F.get("codes", F.lit(d))
        active = written(active.join(few, "key").where(F.size("codes") > d).withColumn("up", F.col("key")).withColumn("key", F.md5(F.concat_ws(":", "key", digit).cast("binary"))), "trie-active")
        d += 1
    inside = reduce(DataFrame.unionByName, local).repartition("key").sortWithinPartitions("key")
    inside = written(inside.mapInArrow(lambda it: _local(it, above), _LOCAL), "trie-local")
    nodes = [inside.where("key IS NULL").drop("key")]
    sums = inside.where("key IS NOT NULL").select("key", F.col("n_children").alias("t_children"), F.col("n_leaves").alias("t_leaves"), F.col("saved").alias("t_saved"))
    done, below = None, None
    for r in range(len(levels) - 1, -1, -1):
        head = levels[r]
        if below is not None:  # split buckets: what their children add up to, and what ends in them
            kids = below.groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")).join(head.select("key", "c_children", "c_leaves", "c_saved"), "key")
            more = F.coalesce("c_children", F.lit(0))
            kids = kids.select("key", (F.col("k") + more).alias("t_children"), (F.col("l") + F.when(more > 0, F.col("c_leaves")).otherwise(0)).alias("t_leaves"), (F.col("s") + F.coalesce("c_saved", F.lit(0))).alias("t_saved"))
            totals = sums.unionByName(kids)
        else:
            totals = sums
        own = F.lit(0).cast("long") if r == 0 else (F.col("n_convs") - 1) * F.col("last")
        done = head.join(totals, "key").select("key", "up", "conv_id", F.lit(above + r).cast("long").alias("depth"), "n_convs", F.col("t_children").alias("n_children"), F.col("t_leaves").alias("n_leaves"), (F.col("t_saved") + own).alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"))
        done = written(done, "trie-done")
        if below is not None:
            parents = done.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id")).join(below.select("up").distinct(), "up", "left_semi")
            nodes.append(below.join(small(parents, p.few), "up").drop("key", "up"))
        below = done
    return reduce(DataFrame.unionByName, nodes), done.drop("up")


def prefix_trie(conversations: DataFrame, p: Trie = Trie()) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (see the module's text)."""
    turns, every = rebuilt(coded(conversations, p), p)
    return trie_of(turns, every, p)


def trie_of(turns: DataFrame, every: DataFrame, p: Trie = Trie()) -> DataFrame:
    """The trie of any sequences: turns (conv_id, depth from 0, code, chars), every (conv_id, n turns)."""
    rows = written(segments(turns, every, p), "trie-rows")
    deepest = rows.agg(F.max("k")).first()[0]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    null = lambda kind: F.lit(None).cast(kind)
    out, beyond = [], None
    for k in range(-1 if deepest is None else deepest, -1, -1):
        here = rows.where(F.col("k") == k)
        same = here.groupBy("bucket", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lo"), F.first("next").alias("next"), F.first("codes").alias("codes"), F.first("chars").alias("chars"))
        same = same.join(endings(here.where("next IS NULL"), p).withColumnRenamed("ends", "e"), ["bucket", "seg"], "left")
        if beyond is None:
            same = same.select("*", null("string").alias("c_ends"), *(null("long").alias(c) for c in ("c_children", "c_leaves", "c_saved")))
        else:
            same = same.join(beyond.select(F.col("key").alias("next"), F.col("ends").alias("c_ends"), F.col("n_children").alias("c_children"), F.col("n_leaves").alias("c_leaves"), F.col("saved").alias("c_saved")), "next", "left")
        same = same.select(F.col("bucket").alias("key"), "codes", "chars", "n", "lo", F.coalesce("e", "c_ends").alias("ends"), "c_children", "c_leaves", "c_saved")
        nodes, beyond = layer(written(same, "trie-same"), k * p.segment, p)
        out.append(nodes.select(*names))
    if beyond is not None:
        out.append(beyond.withColumn("parent_conv_id", null("long")).select(*names))
    found = reduce(DataFrame.unionByName, out) if out else turns.sparkSession.createDataFrame([], _LOCAL.removeprefix("key string, "))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL = f"""
    WITH ordered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id AS c, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
    turns AS (SELECT c, 0 AS part, i, role, text FROM convs JOIN ordered ON conv_id = c - c % 100 AND i <= h UNION ALL SELECT c, 1, i, role, text FROM convs JOIN ordered ON conv_id = c AND i > h),
    seqs AS (SELECT c, coalesce(l, []) AS l FROM convs LEFT JOIN (SELECT c, list(struct_pack(role := role, text := text) ORDER BY part, i) AS l FROM turns GROUP BY c) USING (c)),
    members AS MATERIALIZED (SELECT c, d, len(l) = d AS ends, md5(CAST(to_json(list_slice(l, 1, d)) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN length(l[d].text) ELSE 0 END AS chars FROM seqs, unnest(range(0, len(l) + 1)) t(d)),
    nodes AS MATERIALIZED (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY k, d),
    tree AS MATERIALIZED (SELECT n.*, p.k AS pk, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members p ON p.c = n.conv_id AND p.d = n.d - 1 LEFT JOIN nodes q ON q.k = p.k AND q.d = p.d),
    kids AS (SELECT pk AS k, count(*) AS n FROM tree WHERE d > 0 GROUP BY pk),
    full_tree AS (SELECT t.*, coalesce(kids.n, 0) AS n_children FROM tree t LEFT JOIN kids USING (k)),
    sums AS (SELECT a.k, sum((u.n_children = 0)::INT) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved FROM full_tree u JOIN members a ON a.c = u.conv_id AND a.d <= u.d GROUP BY a.k)
    SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM full_tree JOIN sums USING (k)
"""
