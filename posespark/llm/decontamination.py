"""Benchmark decontamination by an FM-index for each training shard."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, remove, shared_dir, utf8
from .fmindex import FMIndex, occurrences
from .simhash import keyed

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of a training shard, after which a new one starts (a longer text is one shard).
SHARD_WORDS = 2_000_000
#: Benchmark bytes that one pass holds; a larger benchmark takes several passes.
BLOCK_BYTES = 8_000_000

#: Byte table: A-Z to a-z, other than letters, digits and non-ASCII to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: The same words as a pattern over any case.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


@dataclass
class Phrases:
    """The windows of a block of the benchmark, over numbers of its words."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    windows: np.ndarray | None = None
    lengths: np.ndarray | None = None
    items: list[list[str]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: Iterable[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text.encode() if text is not None else None)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add("null" if item is None else str(item))
        table = np.zeros((len(found), window), dtype=np.int64)
        for k, ids in enumerate(found):
            table[k, window - len(ids) :] = ids
        return cls(numbers, table, np.array([len(x) for x in found], dtype=np.int64), [sorted(x) for x in found.values()])


def search_shard(words: np.ndarray, starts: np.ndarray, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """Merged spans of hit words and the items found, for each document of a shard.

    words: numbers of all documents' words with one 0 after each document, 0 also
    for words that the benchmark lacks; starts: where each document begins. The
    index holds each run of benchmark words that is as long as the shortest window
    (no shorter one can hold an occurrence), with a separator after it.
    """
    n_docs = len(starts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[list[str]] = [[] for _ in range(n_docs)]
    if not len(phrases.lengths):
        return spans, items
    known = np.concatenate(([False], words != 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    runs = edges[edges[:, 1] - edges[:, 0] >= phrases.lengths.min()]
    if not len(runs):
        return spans, items
    sizes = runs[:, 1] - runs[:, 0] + 1  # the separator is the 0 that ends the run
    origin = np.repeat(runs[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    symbols = words[origin].astype(np.int64)
    index = FMIndex(symbols, len(phrases.numbers))
    which, at = occurrences(index, phrases.windows, phrases.lengths)
    if not len(which):
        return spans, items
    begin = origin[at]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + phrases.lengths[which], -1)
    hit = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
    merged = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    doc = np.searchsorted(starts, merged[:, 0], side="right") - 1
    for d, (a, b) in zip(doc.tolist(), (merged - starts[doc][:, None]).tolist(), strict=True):
        spans[d].append((a, b))
    doc = np.searchsorted(starts, begin, side="right") - 1
    pairs = np.unique(doc * len(phrases.items) + which)
    for pair in pairs.tolist():
        items[pair // len(phrases.items)].extend(phrases.items[pair % len(phrases.items)])
    return spans, items


def _hits(phrases, shard_words: int):
    """Arrow batches with text, and columns to carry, to the same with n_words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Phrases(**phrases.value)
        get = block.numbers.get
        held: list[pa.RecordBatch] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        room = shard_words

        def flush() -> Iterator[pa.RecordBatch]:
            if not lengths:
                return
            n = np.array(lengths, dtype=np.int64)
            starts = np.cumsum(n + 1) - (n + 1)
            spans, items = search_shard(np.concatenate(parts), starts, block)
            at = 0
            for batch in held:
                here = slice(at, at := at + batch.num_rows)
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns["n_words"] = pa.array(n[here], type=pa.int64())
                columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans[here]], type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                columns["items"] = pa.array([sorted(set(x)) for x in items[here]], type=pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            first = 0
            for i, text in enumerate(utf8(batch.column("text"))):
                words = words_of(text)
                numbers = np.zeros(len(words) + 1, dtype=np.int32)
                numbers[:-1] = [get(w, 0) for w in words]
                parts.append(numbers)
                lengths.append(len(words))
                room -= len(words)
                if room <= 0:
                    held.append(batch.slice(first, i + 1 - first))
                    yield from flush()
                    first, room = i + 1, shard_words
                    held.clear(), lengths.clear(), parts.clear()
            if first < batch.num_rows:
                held.append(batch.slice(first))
        yield from flush()

    return run


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    nothing = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    return F.aggregate(F.array_sort(spans), nothing, lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= last(a)["end"]), grown(a, s)).otherwise(F.concat(a, F.array(s))))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark's windows, in blocks of items whose texts take about block_bytes."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    for k in range(n):
        yield Phrases.of((r[0], r[1]) for r in benchmark.filter(block == k).select("item_id", "text").toLocalIterator())


def _searched(docs: DataFrame, phrases: Phrases, shard_words: int) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(vars(phrases))
    fields = [*docs.schema.fields, *T._parse_datatype_string(HITS).fields]
    return docs.mapInArrow(_hits(sent, shard_words), T.StructType(fields)), sent


def find_spans(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (word numbers, end exclusive, merged) and items.

    Each task indexes its rows in shards of about shard_words words and searches
    every window of the benchmark in each index. A benchmark of up to block_bytes is one pass, and
    nothing is shuffled. A larger one takes a pass over the texts for each block, one after the other: a task
    holds one block, which is let go at the end of its pass; the rows with hits are written by
    the name of their row (simhash.keyed), and all passes' hits of a row meet at the end.

    Null or empty text has no words, no spans and no items. An item without words
    is no window; items of equal text are all reported; an item without id counts
    as 'null'. Repeated rows are judged alike, an empty table gives no rows. Columns of
    docs named n_words, spans or items are replaced.
    """
    docs = docs.drop("n_words", "spans", "items")
    blocks = benchmark_blocks(benchmark, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _searched(docs, first, shard_words)[0]
    rows = keyed(docs)
    texts = rows.select("_k1", "_k2", F.col("_doc.text").alias("text"))
    path = f"{shared_dir(docs.sparkSession)}/spans-{uuid.uuid4().hex}"
    for phrases in chain((first, second), blocks):
        hits, sent = _searched(texts, phrases, shard_words)
        hits.filter(F.size("spans") > 0).select("_k1", "_k2", "spans", "items").write.mode("append").parquet(path)
        sent.destroy()
    every = docs.sparkSession.read.parquet(path).groupBy("_k1", "_k2").agg(
        _merged(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    every = cut(every)
    remove(docs.sparkSession, path)
    met = rows.join(every, ["_k1", "_k2"], "left")
    none = {"spans": "cast(array() as array<struct<start:long,end:long>>)", "items": "cast(array() as array<string>)"}
    n_words = F.coalesce(F.regexp_count(F.col("_doc.text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return met.select("_doc.*", n_words.alias("n_words"), *[F.coalesce(c, F.expr(e)).alias(c) for c, e in none.items()])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find_spans(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


def _cut_out(text: bytes, spans: list[dict]) -> bytes:
    """text without the words of spans and what stands between them."""
    plain = text.translate(WORDS)
    bounds, at = [], 0
    for word in plain.split():
        a = plain.index(word, at)
        at = a + len(word)
        bounds.append((a, at))
    out, last = [], 0
    for s in spans:
        out.append(text[last : bounds[s["start"]][0]])
        last = bounds[s["end"] - 1][1]
    return b"".join([*out, text[last:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the spans of benchmark words cut out of the texts; same columns and rows.

    Null and empty texts stay as they are, repeated rows are cut alike, an empty table gives no rows.
    Extra columns of any name are kept: they travel as one struct.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    found = find_spans(docs.select("text", kept), benchmark.select("item_id", "text"))

    @F.pandas_udf("string")
    def cleaned(text, spans):
        return text.where(spans.map(len) == 0, [None if t is None else _cut_out(t.encode(), s).decode() if len(s) else t for t, s in zip(text, spans, strict=True)])

    return found.select("_doc", cleaned("text", "spans").alias("_text")).select(
        *[F.col("_text").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns]
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window; same columns, whatever their names.

    Null and empty texts stay; repeated rows are judged alike; an empty table gives no rows.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    found = find_spans(docs.select("text", kept), benchmark.select("item_id", "text"))
    return found.filter(F.size("spans") == 0).select("_doc.*")


def digest(items: Iterable[str]) -> str:
    """items_sha256 of a list of item ids, as contamination() gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS_SQL} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, len(w[i:i + {WINDOW - 1}]) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM starts),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
runs AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
found AS (SELECT DISTINCT r, i, n, item FROM runs JOIN windows USING (n, g)),
hit AS (SELECT DISTINCT r, unnest(range(i - 1, i - 1 + n)) AS p FROM found),
islands AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM hit),
merged AS (SELECT r, min(p) AS a, max(p) + 1 AS b FROM islands GROUP BY r, island),
spans AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_hit, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM merged GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (r) LEFT JOIN items USING (r)
"""
