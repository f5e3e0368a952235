"""Text corpora: cleaning, grouping lines, chunking, splitting, n-gram overlap and decontamination."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_blanks, ngrams, normalised, words
from ..work import small, written


def cleaned(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, collapse_blanks(F.col(text)))


def line_groups(lines: DataFrame, text: str, order: str, group: str | None = None, separator: str = "") -> DataFrame:
    """Line records joined to documents; a record of a lone line end (or blank) closes one. The last document is kept.

    Lines run in order inside `group` (a file): documents never cross files, so groups are the unit of work.
    """
    w = Window.partitionBy(*([group] if group else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blank = F.regexp_replace(text, r"[\s]+", "") == ""
    keys = ([group] if group else []) + ["doc"]
    marked = lines.withColumn("doc", F.coalesce(F.sum(blank.cast("long")).over(w), F.lit(0)))
    docs = marked.where(~blank).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator).alias("text"))
    return docs


def chunks(df: DataFrame, size: int, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, chunk, n_words, text: runs of `size` words; the last one may be shorter."""
    w = words(F.col(text))
    n = F.size("_w")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size).cast("int"), F.lit(0)))
    rows = df.select(id_column, w.alias("_w")).where(F.size("_w") > 0).select(id_column, F.posexplode(F.transform(starts, lambda i: F.slice("_w", i * size + 1, F.lit(size)))).alias("chunk", "_c"))
    return rows.select(id_column, "chunk", F.size("_c").alias("n_words"), F.array_join("_c", " ").alias("text"))


def packed_leftovers(parts: DataFrame, size: int, separator: str = "</s>", text: str = "text", n_words: str = "n_words") -> DataFrame:
    """Chunks of full size as they are; shorter ones joined, with a separator, up to the size, in each partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            out = []
            for t, k in zip(b[text], b[n_words], strict=True):
                if k >= size:
                    out.append((t, k))
                    continue
                if held and n + 1 + k > size:
                    out.append((f" {separator} ".join(held), n))
                    held, n = [], 0
                n += k + (1 if held else 0)
                held.append(t)
            yield pd.DataFrame(out, columns=["text", "n_words"])
        if held:
            yield pd.DataFrame([(f" {separator} ".join(held), n)], columns=["text", "n_words"])

    return parts.select(text, n_words).mapInPandas(pack, "text string, n_words long")


def hash_split(df: DataFrame, dev: int, test: int, train: int | None = None, id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds `split`: dev and test take the first rows of a seeded order, train the rest (or so many)."""
    from .sampling import hashed, place_by_hash

    ranked = place_by_hash(df, hashed(seed, id_column), [id_column], most=dev + test + (train or 0))
    split = F.when(F.col("_place") < dev, "dev").when(F.col("_place") < dev + test, "test").otherwise("train")
    marked = ranked.withColumn("split", split)
    return (marked.where(F.col("_place") < dev + test + train) if train else marked).drop("_place")


def _prints(df: DataFrame, text: str, n: int, *keep: str) -> DataFrame:
    """The kept columns, place (from 0), a, b: of each word n-gram two 64-bit hashes of its words' hashes.

    Only hashes are exploded and shuffled, never n-grams, which hold a text n times. Seeds differ, also for the words, so
    different n-grams agree in both hashes with a probability of about 2^-128 a pair. Words and their hashes are columns
    of their own: they are worked out once, not once an n-gram.
    """
    split = df.select(*keep, words(normalised(F.col(text))).alias("_w"))
    hashes = split.select(*keep, F.transform("_w", lambda x: F.xxhash64(x)).alias("_a"), F.transform("_w", lambda x: F.xxhash64(F.lit(1), x)).alias("_b"))
    prints = F.transform(F.sequence(F.lit(1), F.size("_a") - n + 1), lambda i: F.struct(F.xxhash64(F.slice("_a", i, n)).alias("a"), F.xxhash64(F.lit(1), F.slice("_b", i, n)).alias("b")))
    return hashes.select(*keep, F.posexplode(F.when(F.size("_a") >= n, prints)).alias("place", "_g")).select(*keep, "place", "_g.a", "_g.b")


#: Different n-grams of the items up to which they are broadcast (16 bytes each): the documents' n-grams then meet them where they are.
FEW_GRAMS = 1_000_000


def _known(items: DataFrame, text: str, n: int, *keep: str, few: int | None = None) -> DataFrame:
    """The items' different n-gram hashes with the kept columns, written once; broadcast if a count says they are few, else for a merge join."""
    return small(written(_prints(items, text, n, *keep).drop("place").distinct(), "ngrams"), FEW_GRAMS if few is None else few)


def overlap(docs: DataFrame, items: DataFrame, n: int = 13, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Distinct (doc_id, item_id) pairs that share a word n-gram: an equi-join on 128 bits of hashes."""
    return _prints(docs, text, n, doc_id).join(_known(items, text, n, item_id), ["a", "b"]).select(doc_id, item_id).distinct()


class ContaminantIndex:
    """Items' n-gram hashes as a bucketed table that stays, and a bit map of them to look up documents' n-grams in first.

    The table lies under `path` and is clustered by its hashes, so a join with it shuffles only the documents' n-grams,
    and of these only the ones whose bit is set. The bit map has a bit for each hash modulo its size: at least `spread`
    bits an n-gram of the index, up to 2 ** `most_bits` bits (2 ** 30: 128 MB), which is what is broadcast. It is made again
    only when items were added. Items are added by appending; items added twice count once.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = 13, buckets: int = 64, item_id: str = "item_id", kind: str = "bigint", spread: int = 64, most_bits: int = 30):
        self.spark, self.path, self.n, self.item_id, self.spread, self.most_bits = spark, path.rstrip("/"), n, item_id, spread, most_bits
        self.name = f"ngrams_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (a BIGINT, b BIGINT, `{item_id}` {kind}) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {buckets} BUCKETS LOCATION '{self.path}/grams'")
        self._bits: tuple[DataFrame, int] | None = None

    def add(self, items: DataFrame, text: str = "text") -> None:
        """Append items' n-grams; nothing that is there is read or written again."""
        grams = _prints(items, text, self.n, self.item_id).select("a", "b", self.item_id).distinct()
        grams.write.insertInto(self.name)
        self._bits = None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def bits(self) -> tuple[DataFrame, int]:
        """(bucket, bitmap) rows of 32,768 bits each, and the number of bits."""
        if self._bits is None:
            width = 15
            while width < self.most_bits and (1 << width) < self.spread * self.table().count():
                width += 1
            place = F.pmod("a", F.lit(1 << width)) + 1
            rows = self.table().groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
            self._bits = written(rows, "ngram-bits"), 1 << width
        return self._bits

    def candidates(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, place, a, b): the documents' n-grams whose bit is set; no shuffle."""
        rows, size = self.bits()
        place = F.pmod("a", F.lit(size)) + 1
        prints = _prints(docs, text, self.n, doc_id).withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place).cast("int")})
        byte = F.conv(F.hex(F.substring("bitmap", F.call_function("div", F.col("bit"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = prints.join(F.broadcast(rows), "bucket")
        return found.where(F.call_function("shiftright", byte, F.col("bit") % 8).bitwiseAND(1) == 1).select(doc_id, "place", "a", "b")

    def overlap(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Distinct (doc_id, item_id) pairs that share an n-gram."""
        return self.candidates(docs, doc_id, text).join(self.table().hint("merge"), ["a", "b"]).select(doc_id, self.item_id).distinct()


def contaminant_ngrams(items: DataFrame, n: int = 13, text: str = "text") -> DataFrame:
    return items.select(words(normalised(F.col(text))).alias("_w")).select(F.explode(ngrams(F.col("_w"), n)).alias("ngram")).distinct()


def _hits(docs: DataFrame, items: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, place: n-grams of the documents that occur in the items."""
    return _prints(docs, text, n, doc_id).join(_known(items, text, n), ["a", "b"]).select(doc_id, "place")


def hit_counts(docs: DataFrame, items: DataFrame, n: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, hits: how many word n-grams of each document (places, not kinds) occur in the items."""
    found = _hits(docs, items, n, text, doc_id).groupBy(doc_id).agg(F.count(F.lit(1)).alias("hits"))
    return docs.select(doc_id).join(found, doc_id, "left").select(doc_id, F.coalesce("hits", F.lit(0)).alias("hits"))


def word_spans(text: str, n: int) -> list[tuple[str, int, int]]:
    """Word n-grams, normalised, with the character range that each covers."""
    import re

    from ..functions.text import LOWER, PUNCTUATION, UPPER

    table = str.maketrans(UPPER, LOWER, PUNCTUATION)
    found = [(m.group().translate(table), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    found = [x for x in found if x[0]]
    return [(" ".join(w for w, _, _ in found[i : i + n]), found[i][1], found[i + n - 1][2]) for i in range(len(found) - n + 1)]


def clean_parts(text: str, hits: list[tuple[int, int]], window: int = 200, least: int = 200, most_hits: int = 10) -> list[str] | None:
    """What is left of a text without the windows round its hits; None at more than `most_hits`.

    Parts before a hit are longer than `least`. The last part begins one character after the last window
    and has `least` characters or more; so has a text without hits, or it gives no part.
    """
    if len(hits) > most_hits:
        return None
    out, at = [], 0
    for a, b in sorted(hits):
        if a - window - at > least:
            out.append(text[at : a - window])
        at = min(len(text), b + window)
    rest = text[at + 1 :] if hits else text
    return [*out, rest] if len(rest) >= least else out


def _kept_ranges(spans: Column, size: Column, window: int, least: int) -> Column:
    """(start, stop) of what `clean_parts` keeps, as a Column: each span's cut ends where the next part begins."""
    after = lambda s: F.least(size, s["stop"] + window)
    before = F.transform(spans, lambda s, i: F.struct(F.when(i > 0, after(F.get(spans, i - 1))).otherwise(0).alias("start"), (s["start"] - window).alias("stop")))
    rest = F.when(F.size(spans) > 0, after(F.element_at(spans, -1)) + 1).otherwise(0)
    last = F.filter(F.array(F.struct(rest.alias("start"), size.alias("stop"))), lambda s: s["stop"] - s["start"] >= least)
    return F.concat(F.filter(before, lambda s: s["stop"] - s["start"] > least), last)


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 13, window: int = 200, least: int = 200, most_hits: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, hits, part, text: cleaned parts of each document; documents with too many hits give no part.

    Hits come from a join of n-gram hashes. A hit's characters are found from the lengths of the words up to it, and the
    windows round hits are cut between neighbours, all in Columns: only a document's hits, at most `most_hits`, are worked on.
    """
    found = _hits(docs, items, n, text, doc_id).groupBy(doc_id).agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("place")).alias("_places"))
    split = docs.select(doc_id, F.coalesce(text, F.lit("")).alias("text")).join(found, doc_id, "left").where(F.coalesce("hits", F.lit(0)) <= most_hits)
    dirty = F.col("_places").isNotNull()
    pieces = split.withColumn("_words", F.when(dirty, F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0))))  # blanks belong to the word after them
    counts = F.filter(F.transform("_words", lambda w, i: F.when(F.trim(normalised(F.regexp_replace(w, r"\s", ""))) != "", i)), lambda i: i.isNotNull())
    numbered = pieces.withColumn("_own", counts)  # a word of punctuation alone has no number
    stop = lambda i: F.length(F.array_join(F.slice("_words", F.lit(1), i + 1), ""))
    first = lambda p: F.get("_own", p)
    span = lambda p: F.struct((stop(first(p)) - F.length(F.regexp_replace(F.get("_words", first(p)), r"^\s+", ""))).alias("start"), stop(first(p + n - 1)).alias("stop"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    spans = numbered.select(doc_id, "text", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.when(dirty, F.transform("_places", span)).otherwise(none).alias("_spans"))
    ranges = spans.select(doc_id, "hits", "text", F.posexplode(_kept_ranges(F.col("_spans"), F.length("text"), window, least)).alias("part", "_r"))
    return ranges.select(doc_id, "hits", "part", F.substring("text", F.col("_r.start") + 1, F.col("_r.stop") - F.col("_r.start")).alias("text"))


def token_counts(c: Column) -> tuple[Column, Column]:
    """White-space words and UTF-8 bytes."""
    return F.size(words(c)), F.octet_length(c)
