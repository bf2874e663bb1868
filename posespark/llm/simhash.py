"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, utf8

#: Words of a shingle, seed of its hash, and the most bits in which linked fingerprints differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that share a segment's value, above which a whole-fingerprint search takes them.
BUCKET_LIMIT = 32
LOW_MASK = 0xFFFFFFFF


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles in order; of all words where they are fewer, none without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the hashes of a text's shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    if n == 1:
        return int(hashes[0])
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):  # unpacked bits take 64 times the shingles
        votes += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """Adds fp, the fingerprint as a signed long, and leaves text out."""
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t) for t in utf8(batch.column("text"))), dtype=np.uint64, count=batch.num_rows)
            columns = {f.name: batch.column(f.name) for f in keep}
            yield pa.RecordBatch.from_pydict(columns | {"fp": pa.array(prints.view(np.int64))})

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("fp", T.LongType())]))


def _ball(value: Column, bits: range) -> Column:
    """value, and value with each one of these bits that is 0 set to 1."""
    flips = [F.when(value.bitwiseAND(F.lit(_bit(b))) == 0, value.bitwiseOR(F.lit(_bit(b)))) for b in bits]
    return F.array_compact(F.array(value, *flips))


def _bit(b: int) -> int:
    return 1 << b if b < 63 else -(1 << 63)


def near_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that link all which differ in 2 bits or fewer.

    Multi-index hashing with two 32-bit segments: of two fingerprints within 2 bits,
    either the low segments are equal or the high ones differ in one bit at most.
    So the table holds each fingerprint under its two segments, and a query
    fetches the entries under its low segment and under the small Hamming ball of its
    high segment (only bits set from 0 to 1: the other side's query covers the
    reverse); whole distances are verified.

    Segments shared by more than BUCKET_LIMIT fingerprints would pair up all of a
    large group of near copies. Fingerprints that query or hold such a segment are
    instead searched over the whole fingerprint: each is put under every value
    within 1 bit, two within 2 bits meet under some value, no value has more than
    65, and each is linked with the least there. Every link that is left out joins
    two fingerprints that are linked through that least one.
    """
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(LOW_MASK)), F.shiftrightunsigned(fp, 32)
    table = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))).alias("e")).select("fp", "e.*")
    probes = prints.select("fp", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("seg"), low.alias("key"))),
        F.transform(_ball(high, range(32)), lambda k: F.struct(F.lit(1).alias("seg"), k.alias("key"))),
    )).alias("e")).select("fp", "e.*")
    crowded = cut(table.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_LIMIT).select("seg", "key"))
    fetched = table.join(crowded, ["seg", "key"], "left_anti").withColumnRenamed("fp", "other")
    pairs = (
        probes.join(fetched, ["seg", "key"])
        .filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    hot = probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
    around = hot.select("fp", F.explode(F.concat(F.array(fp), F.array(*[fp.bitwiseXOR(F.lit(_bit(b))) for b in range(64)]))).alias("near"))
    least = around.groupBy("near").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    meets = least.select("a", F.explode("all").alias("b")).filter("a != b")
    return pairs.unionByName(meets).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of the links.

    Alternates two steps over the links until they no longer change: every node's
    larger neighbours, then its smaller ones, are tied to the least neighbour. Minima are taken before rows
    move, so a node with very many links is no hot spot in the aggregate, and its join can be split. The number of
    rounds grows with the logarithm of the longest chain; each round is cut, and a count and a checksum
    tell the end (not by an Observation: a session that has one cannot send a fitted forest to its tasks).
    """
    edges, before = cut(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").repartition("u")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _roots(tagged: DataFrame) -> DataFrame:
    """(fp, root) of fingerprints that are linked to others."""
    prints = cut(tagged.select("fp").distinct())
    found = components(near_links(prints))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return cut(found.unionByName(roots).select(F.col("node").alias("fp"), "root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    component_id is the least doc_id that a chain of links reaches, the document's own
    included. Fingerprints link at RADIUS bits or fewer; equal ones always.

    Null, empty and blank texts have fingerprint zero and are linked like any other.
    A null doc_id is passed over in the least, and the component of rows without
    any id is null. Repeated rows share a component; all rows are returned. An empty
    table gives no rows; extra columns are ignored.
    """
    tagged = cut(with_fingerprints(docs.select("doc_id", "text")))
    roots = _roots(tagged)
    firsts = tagged.groupBy("fp").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return tagged.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def keyed(docs: DataFrame) -> DataFrame:
    """_doc, the row itself, with _k1 and _k2, two hashes of its columns (but for maps and variants).

    They name rows by value, so a row keeps its name when docs is read again.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    values = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]
    return docs.select(F.xxhash64(*values).alias("_k1"), F.xxhash64(F.lit(SEED), *values).alias("_k2"), F.struct(*columns).alias("_doc"))


def chosen_rows(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (_k1, _k2, doc_id, root): the names that are not the least of their root, and the least that several rows have."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    best = cut(named.groupBy("root").agg(F.min(order).alias("best")).select("best._k1", "best._k2"))
    names = cut(named.groupBy("_k1", "_k2").agg(F.count("*").alias("rows")))
    dropped = cut(names.join(best, ["_k1", "_k2"], "left_anti").select("_k1", "_k2"))
    return dropped, cut(names.filter("rows > 1").select("_k1", "_k2").join(best, ["_k1", "_k2"], "left_semi"))


def with_rows(keyed: DataFrame, chosen: tuple[DataFrame, DataFrame], send: int) -> DataFrame:
    """The rows of keyed that chosen_rows leaves, one of repeated rows; up to `send` names go to every task, so that rows stay in place."""
    keys = ["_k1", "_k2"]
    dropped, repeated = (F.broadcast(x) if x.count() <= send else x for x in chosen)
    left = keyed.join(dropped, keys, "left_anti")
    if not chosen[1].isEmpty():
        left = left.join(repeated, keys, "left_anti").unionByName(left.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return left.select("_doc.*")


def drop_near_duplicates(docs: DataFrame, send: int = 500_000) -> DataFrame:
    """docs with one row of each component: least doc_id (null last), of repeated rows one.

    Null, empty and blank texts have fingerprint zero and are linked like any other. An empty table gives
    no rows; other columns stay as they are, whatever their names.
    """
    rows = keyed(docs)
    tagged = cut(with_fingerprints(rows.select("_k1", "_k2", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))))
    named = tagged.join(_roots(tagged), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return with_rows(rows, chosen_rows(named), send)
