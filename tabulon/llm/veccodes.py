"""Product codes of vectors in integers: each part is replaced by the nearest entry of its codebook.

Components become integers floor(scale * x); a vector is cut into `parts` equal consecutive parts. A part
position's codebook starts as that part of the vectors of least id. In each round every part goes to its
nearest entry, and an entry becomes the rounded-down mean of its parts; unused entries stay.

Nearest entries are found by segment means. Over a block of m components, the squared distance is at least
m times the squared difference of the means plus the squared difference of the norms of what is left when
the mean is taken off. Bounds over one block, then two, then four (`levels`) rule out entries whose bound
lies above the exact distance to the most promising one. Bounds are lowered by far more than their rounding
error, so no nearest entry and no tie is lost. Survivors get exact integer distances; ties go to the lower
index.

On Spark, tasks add up their parts by entry and send one number for each component of the codebooks, so a
round shuffles entries * width numbers a task, and the driver gets entries * width of them in all, whatever
the number of rows. Labels' sums come from an aggregate and a join that is a broadcast only if the labels
are few (counted).

Defined results: vectors that are null, hold null or non-finite components, or a component of magnitude 2 ** 40
or more (its squares fit no long) are dropped; null ids are coded, but come last when codebooks start. Rows
of a repeated id are coded each for itself, ties between them go by the vector. Vectors of another length
than the most frequent multiple of `parts` (of equally frequent ones the shorter) have null code, error and
label_error. Fewer vectors than `entries` make smaller codebooks. An error or sum beyond a long is null. An
empty table gives an empty result. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


@dataclass(frozen=True)
class Coding:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    levels: tuple[int, ...] = (1, 2, 4)
    block_rows: int = 8192
    #: Labels whose sums are broadcast at most.
    few_labels: int = 100_000


#: Magnitude below which integers and their distances (of up to 4096 components) stay in 64 bits.
_NARROW = 1 << 24
_LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; Python integers where 64 bits might not do."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() * scale < _NARROW:
        return np.floor(x * scale).astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(Fraction(v) * scale), 1, 1)(x)


class Bounds:
    """Block sums and residual norms of rows, for lower bounds of their distances to others."""

    def __init__(self, x: np.ndarray, blocks: int):
        width = x.shape[1]
        self.at = np.unique(np.linspace(0, width, min(blocks, width) + 1).astype(int))[:-1]
        self.m = np.diff(np.append(self.at, width)).astype(np.float64)
        self.sums = np.add.reduceat(x, self.at, axis=1).astype(np.float64)
        squares = np.add.reduceat(x * x, self.at, axis=1).astype(np.float64)
        self.rest = np.sqrt(np.maximum(squares - self.sums**2 / self.m, 0))
        self.norm = squares.sum(axis=1)

    def below(self, i, other: Bounds, k) -> np.ndarray:
        """Lower bounds for rows i against rows k of `other`: less a share of the norms that no rounding reaches."""
        bound = ((self.sums[i] - other.sums[k]) ** 2 / self.m + (self.rest[i] - other.rest[k]) ** 2).sum(axis=-1)
        return bound - 1e-9 * (self.norm[i] + other.norm[k]) - 1e-6


def nearest_entries(x: np.ndarray, book: np.ndarray, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (ties to the lower one), its exact squared distance, and the number of exact distances."""
    if x.dtype == object or book.dtype == object:  # wide integers: all distances
        d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        index = np.array([min(range(len(book)), key=row.__getitem__) for row in d], np.int64)
        return index, d[np.arange(len(x)), index], d.size
    rows = np.arange(len(x))
    coarse, entries = Bounds(x, levels[0]), Bounds(book, levels[0])
    bound = coarse.below(rows[:, None], entries, np.arange(len(book))[None, :])
    first = bound.argmin(axis=1)
    upper = ((x - book[first]) ** 2).sum(axis=1)
    i, k = np.nonzero(bound <= upper[:, None])
    for blocks in levels[1:]:
        stays = Bounds(x, blocks).below(i, Bounds(book, blocks), k) <= upper[i]
        i, k = i[stays], k[stays]
    d = ((x[i] - book[k]) ** 2).sum(axis=1)
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))  # each row keeps its first candidate at least
    least = np.minimum.reduceat(d, starts)
    at = np.flatnonzero(d == least[i])
    at = at[np.append(True, i[at][1:] != i[at][:-1])]
    return k[at], d[at], len(d) + len(x)


def _blocks(batch: pa.RecordBatch, width: int, p: Coding) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for s in range(0, batch.num_rows, p.block_rows):
        part = batch.slice(s, p.block_rows)
        v = part.column("v").flatten().to_numpy(zero_copy_only=False)
        yield part, integers(v.reshape(part.num_rows, p.parts, width), p.scale)


def _summed(batches: Iterator[pa.RecordBatch], books: np.ndarray, p: Coding) -> Iterator[pa.RecordBatch]:
    """A task's parts added up by entry, and how many they are: one row for each slot of `books`, then one for each entry."""
    parts, entries, width = books.shape
    total, count = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
    for batch in batches:
        for _, x in _blocks(batch, width, p):
            for j in range(parts):
                own, _, _ = nearest_entries(x[:, j], books[j], p.levels)
                count[j] += np.bincount(own, minlength=entries)
                sums = np.zeros((entries, width), x.dtype)
                np.add.at(sums, own, x[:, j])
                total[j] += sums
    if count.any():
        numbers = [*total.reshape(-1).tolist(), *count.reshape(-1).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers)), pa.int64()), pa.array([Decimal(int(n)) for n in numbers], pa.decimal128(38, 0))], names=["slot", "total"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, p: Coding) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for part, x in _blocks(batch, width, p):
            found = [nearest_entries(x[:, j], books[j], p.levels)[:2] for j in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1].astype(object) for f in found)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array([e if e <= _LONG else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])


def usable(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v) without vectors that can't be coded."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= float(1 << 40)))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))


def width_of(rows: DataFrame, parts: int) -> int:
    """The most frequent length that `parts` divides, 0 if there is none."""
    size = F.size("v")
    found = rows.where((size > 0) & (size % parts == 0)).groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def codebooks(rows: DataFrame, width: int, p: Coding = Coding()) -> np.ndarray:
    """Integers by part, entry and position, after all rounds, from rows (vec_id, v) of one length."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(p.entries).collect()
    books = integers(np.array([r[0] for r in first]), p.scale).reshape(len(first), p.parts, width // p.parts).transpose(1, 0, 2)
    for _ in range(p.rounds):
        now = books
        sums = rows.select("v").mapInArrow(lambda it, now=now: _summed(it, now, p), "slot long, total decimal(38,0)").groupBy("slot").agg(F.sum("total").alias("total"))
        by = {r["slot"]: int(r["total"]) for r in sums.collect()}  # one number for each slot of the codebooks
        total = np.array([by[i] for i in range(books.size)], object).reshape(books.shape)
        count = np.array([by[books.size + i] for i in range(books.shape[0] * books.shape[1])], object).reshape(books.shape[:2])
        new = np.array([[[t // n for t in entry] if n else old.tolist() for entry, n, old in zip(*z, strict=True)] for z in zip(total, count, books, strict=True)], object)
        books = new.astype(np.int64) if all(abs(v) < _NARROW for v in new.reshape(-1)) else new
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", p: Coding = Coding()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector (see the module's text)."""
    if p.entries > 256:
        raise ValueError("codes of two hex digits tell 256 entries apart")
    rows = written(usable(vectors, id_column, vector, label), "codes-vectors")
    width = width_of(rows, p.parts)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    names, fits = ["vec_id", "code", "error", "label_error", "codebooks_sha256"], F.size("v") == width if width else F.lit(False)
    null = F.lit(None)
    odd = rows.where(~fits).select("vec_id", null.cast("string").alias("code"), null.cast("long").alias("error"), null.cast("long").alias("label_error"), null.cast("string").alias("codebooks_sha256"))
    if not width:
        return odd
    books = codebooks(rows.where(fits), width, p)
    coded = written(rows.where(fits).mapInArrow(lambda it: _coded(it, books, p), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error"))
    out = coded.join(small(sums, p.few_labels), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.withColumn("codebooks_sha256", F.lit(digest(books))).select(*names).unionByName(odd.withColumn("codebooks_sha256", F.lit(digest(books))))


def exact_distances(vectors: DataFrame, books: np.ndarray, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", p: Coding = Coding()) -> DataFrame:
    """(rows, entries, exact): parts coded, entries they were compared with by bounds, and exact distances that were worked out."""
    rows = usable(vectors, id_column, vector, label).where(F.size("v") == p.parts * books.shape[2]).select("v")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, books.shape[2], p):
                n = sum(nearest_entries(x[:, j], books[j], p.levels)[2] for j in range(p.parts))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows * p.parts]), pa.array([part.num_rows * p.parts * books.shape[1]]), pa.array([n])], names=["rows", "entries", "exact"])

    return rows.mapInArrow(counted, "rows long, entries long, exact long").agg(F.sum("rows").alias("rows"), F.sum("entries").alias("entries"), F.sum("exact").alias("exact"))


def _sql(p: Coding = Coding()) -> str:
    """The same for DuckDB: distances to all entries, without bounds."""
    nearest = lambda book: f"""SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT a.vec_id, a.p, c.e, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM parts a JOIN {book} c USING (p)) GROUP BY vec_id, p"""  # noqa: E731
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({p.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * (len(v) // {p.parts}) + 1, (p + 1) * (len(v) // {p.parts})) AS v FROM kept, range({p.parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {p.entries}) USING (vec_id))"]
    for r in range(p.rounds):
        steps += [
            f"own{r} AS MATERIALIZED ({nearest(f'book{r}')})",
            f"""flat{r} AS (SELECT p, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM own{r} JOIN parts USING (vec_id, p))""",
            f"""mean{r} AS (SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM flat{r} GROUP BY p, e, i))""",
            f"""book{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM book{r} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM mean{r} GROUP BY p, e) m USING (p, e))""",
        ]
    return f"""WITH {', '.join(steps)}, last AS ({nearest(f'book{p.rounds}')}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{p.rounds})) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


SQL = _sql()
