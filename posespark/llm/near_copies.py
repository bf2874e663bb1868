"""Near copies by the share of common shingles: SimHash links first, then all pairs that it can't see.

Fingerprints of 64 bits tell copies with a few changes apart from all else, but not a share
of four fifths: there they differ in ten bits on average, and no segment of a useful length
keeps a small ball. So the links that multi-index hashing finds are completed by sets that
have one of their rarest shingles in common, and every link of either kind is decided by whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import Scratch, cut, utf8

#: Words of a shingle, and the least share of common shingles as a fraction.
SHINGLE, SHARE = 5, (4, 5)
#: Frequent shingles come last in the order. They are looked for in a tenth of the texts, in so many
#: at least; so many different texts make a shingle frequent, and so many shingles are kept at most.
SAMPLE, SAMPLED, SEEN, MOST = 2_000, 0.1, 3, 500_000
#: Of one in so many shingles a set is also held against its neighbour under the shingle.
NEIGHBOURS = 4
#: Sets that one task holds under a frequent shingle, by the estimate.
HELD = 2_000
#: Most keys of rows or sets that are sent to every task, and most pairs of one set in a task's key.
SEND, SPREAD = 500_000, 256
#: Parity bits for each shingle of a set, and of the short parities that go with rows.
PARITY, SHORT = 2, 256


def _set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, shingle))


def _sets(texts: list[bytes | None], shingle: int) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(texts), 500):  # sets are larger than texts
        yield [_set(t, shingle) for t in texts[i : i + 500]]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are common in a sample of the different texts, and how many of these may have them.

    A text is drawn by its own hash, so its copies count once. The sample settles the order only, not the result.
    """
    rows = texts.count()
    share = min(1.0, max(SAMPLED, SAMPLE / max(rows, 1))) if SAMPLE else 0.0
    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for sets in _sets(utf8(batch.column("text")), shingle):
                prints = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                new = [fp not in seen and not seen.add(fp) for fp in prints.tolist()]
                hashes = [s if fresh else s[:0] for s, fresh in zip(sets, new, strict=True)]
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(hashes).view(np.int64)), "fp": pa.array(np.repeat(prints, [len(h) for h in hashes]))})

    counts = part.mapInArrow(run, "h long, fp long").distinct().groupBy("h").agg(F.count("*").alias("n"))  # a shingle of every page is counted in parts
    table = counts.filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    hashes, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    by_hash = np.argsort(hashes)
    return hashes[by_hash], (n[by_hash] / max(share, 1e-9)).astype(np.int64)


def _prefix(table: Broadcast, share: tuple[int, int]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The first hashes of a set, of which two sets with the share have one in common, and their counts.

    Any one order of hashes serves; here the frequent ones come last, by count.
    """
    p, q = share

    def take(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (frequent, counts), n = table.value, len(hashes)
        count = np.zeros(n, dtype=np.int64)
        if n and len(frequent):
            at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
            count = np.where(frequent[at] == hashes, counts[at], 0)
        first = np.lexsort((hashes, count))[: n + (-p * n) // q + 1] if n else np.empty(0, dtype=np.int64)
        return hashes[first], count[first]

    return take


def _parity(hashes: np.ndarray, n_bits: int | None = None) -> np.ndarray:
    """Parities of a set's hashes in buckets, packed in words: without n_bits a power of two at PARITY bits a hash or more.

    Two sets differ in at least as many hashes as their parities differ in bits.
    """
    n_bits = n_bits or 1 << max(6, (PARITY * len(hashes) - 1).bit_length())
    bits = np.bincount((hashes & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _tagged(keyed: DataFrame, shingle: int, take: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """_k1, _k2 and doc_id with the hash of the set, its size, the fingerprint, parities and first hashes.

    Parities and first hashes are given once for each distinct set of a task, so a large group of copies
    makes few of them; null otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for sets in _sets(utf8(batch.column("text")), shingle):
                part = batch.slice(at, len(sets))
                at += len(sets)
                prints = [xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
                new = []
                for fp in prints:
                    new.append(fp not in seen)
                    seen.add(fp)
                firsts = [take(s) if fresh else (s[:0], np.empty(0, dtype=np.int64)) for s, fresh in zip(sets, new, strict=True)]
                none = np.empty(0, dtype="<i8")
                parity = [_parity(s) if fresh else none for s, fresh in zip(sets, new, strict=True)]
                short = [_parity(s, SHORT) if fresh else none for s, fresh in zip(sets, new, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "_k1": part.column("_k1"), "_k2": part.column("_k2"), "doc_id": part.column("doc_id"),
                    "fp": pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                    "n": pa.array([len(s) for s in sets], type=pa.int32()),
                    "bits": pa.array([simhash.majority(s) if fresh else 0 for s, fresh in zip(sets, new, strict=True)], type=pa.uint64()).view(pa.int64()),
                    "fresh": pa.array(new),
                    "parity": _lists(parity), "short": _lists(short), "hashes": _lists([h for h, _ in firsts]), "counts": _lists([c for _, c in firsts]),
                })

    many = T.ArrayType(T.LongType())
    kinds = {"_k1": T.LongType(), "_k2": T.LongType(), "doc_id": keyed.schema["doc_id"].dataType, "fp": T.LongType(), "n": T.IntegerType()}
    kinds |= {"bits": T.LongType(), "fresh": T.BooleanType(), "parity": many, "short": many, "hashes": many, "counts": many}
    return keyed.select("_k1", "_k2", "doc_id", "text").mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def _can(x: str, y: str, share: tuple[int, int]) -> Column:
    """Whether two sets whose first common hash is at these places can have the share."""
    p, q = share
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * left >= p * (n + m))


def _folded(a: str, b: str) -> Column:
    """Bits in which two parities differ, the longer one folded to the length of the other."""
    short = F.least(F.size(a), F.size(b))

    def fold(x: str) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), short), F.slice(x, short + 1, short), lambda u, v: u.bitwiseXOR(F.coalesce(v, F.lit(0))))
        return F.when(F.size(x) > short, half).otherwise(F.col(x))

    return F.aggregate(F.zip_with(fold(a), fold(b), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)


def _close(a: str, b: str, size: Column, share: tuple[int, int]) -> Column:
    """Whether sets of these parities, with so many shingles together, can have the share."""
    p, q = share
    return (p + q) * _folded(a, b) <= (q - p) * size


class _Verifier:
    """Decides pairs of sets: sizes, then parities, then the sets themselves."""

    def __init__(self, keyed: DataFrame, sets: DataFrame, shingle: int, share: tuple[int, int], tables: Scratch):
        self.keyed, self.sets, self.shingle, self.share, self.tables = keyed, sets, shingle, share, tables

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and parities do not rule out."""
        p, q = self.share
        side = lambda k: self.sets.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        sizes = q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")
        return both.filter(sizes).filter(_close("parity_a", "parity_b", F.col("n_a") + F.col("n_b"), self.share)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets have the share.

        Each set is made again from one text; a set in many pairs is sent under several keys.
        """
        p, q = self.share
        pairs = cut(self.likely(pairs.distinct()))
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("uses")))
        few = wanted.count() <= SEND
        wanted = F.broadcast(wanted) if few else wanted
        keys = self.sets.join(wanted, "fp").select("fp", "uses", F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2"))
        made = self.tables.write(self._made(self.keyed.join(F.broadcast(keys) if few else keys, ["_k1", "_k2"])), "near-sets")
        spread = lambda n: F.floor(n / SPREAD).cast("int")
        made = made.dropDuplicates(["fp"]).withColumn("copy", F.explode(F.sequence(F.lit(0), spread(F.col("uses")))))
        often = cut(wanted.filter(F.col("uses") >= SPREAD).select("fp", spread(F.col("uses")).alias("more")))
        some = not often.isEmpty()
        often = F.broadcast(often) if often.count() <= SEND else often

        def dealt(df: DataFrame, key: str, other: str) -> DataFrame:
            if not some:
                return df.withColumn(f"{key}_copy", F.lit(0))
            more = F.coalesce(F.col("more"), F.lit(0)) + 1
            return df.join(often.withColumnRenamed("fp", key), key, "left").withColumn(f"{key}_copy", F.pmod(F.xxhash64(other), more).cast("int")).drop("more")

        def side(key: str) -> DataFrame:
            return made.select(F.col("fp").alias(key), F.col("copy").alias(f"{key}_copy"), F.col("n").alias(f"n_{key}"), F.col("hashes").alias(f"h_{key}"))

        both = dealt(dealt(pairs, "a", "b"), "b", "a").join(side("b"), ["b", "b_copy"]).join(side("a"), ["a", "a_copy"])
        return cut(both.filter((p + q) * F.size(F.array_intersect("h_a", "h_b")) >= p * (F.col("n_a") + F.col("n_b"))).select("a", "b"))

    def _made(self, rows: DataFrame) -> DataFrame:
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for sets in _sets(utf8(batch.column("text")), shingle):
                    yield pa.RecordBatch.from_pydict({"fp": batch.column("fp").slice(at, len(sets)), "uses": batch.column("uses").slice(at, len(sets)), "n": pa.array([len(s) for s in sets], type=pa.int64()), "hashes": _lists(sets)})
                    at += len(sets)

        return rows.select("fp", "uses", "text").mapInArrow(run, "fp long, uses long, n long, hashes array<long>")


def _sent(roots: DataFrame) -> DataFrame:
    return F.broadcast(roots) if roots.count() <= SEND else roots


def _named(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the root of the node; a node without links is its own."""
    found = roots.select(F.col("node").alias("_node"), F.col("root").alias(name))
    return rows.join(found, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce(name, F.col(node))).drop("_node")


def _grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links so far: the roots known, with those that the new links tie made one."""
    if roots is not None:
        tied = _named(_named(links, roots, "a", "root_a"), roots, "b", "root_b").filter("root_a != root_b")
        links = tied.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
    found = simhash.components(links)
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    if roots is not None:
        found = cut(found)
        moved = _named(roots.withColumnRenamed("root", "old"), found, "old", "root").select("node", "root")
        found = moved.unionByName(found.join(roots.select("node"), "node", "left_anti"))
    return _sent(cut(found))


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of sets (a, b), a < b, that fingerprints of 64 bits link: equal ones, and by multi-index hashing those within 2 bits."""
    one = cut(sets.groupBy("bits").agg(F.min("fp").alias("one")))
    equal = sets.join(one, "bits").filter("fp != one").select(F.least("one", "fp").alias("a"), F.greatest("one", "fp").alias("b"))
    near = simhash.near_links(one.select(F.col("bits").alias("fp")))
    of = lambda k: one.select(F.col("bits").alias(k), F.col("one").alias(f"{k}_fp"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))
    return equal.unionByName(near)


def near_roots(tagged: DataFrame, verifier: _Verifier) -> DataFrame:
    """(node, root) of the sets that chains of links join; a link is a pair with at least the share of common shingles.

    Candidates are, first, the pairs that SimHash links. Then: two sets with the share have a hash in common among
    the first n - ceil(share n) + 1 of each in one order of all hashes, so the rows that share one of these are
    candidates; sizes and places of the hash rule out most. Each row is held against the least under the
    same hash, under some hashes also against the next one in a random order. Rows of a frequent hash are dealt
    over several tasks, each with its own least. At last the sets that share a hash and are not joined yet are
    held against each other, but for those that belong to the commonest group under the hash, so that a
    large group of near copies does not pair up; only pairs that short parities do not rule out leave that join.
    """
    share, tables = verifier.share, verifier.tables
    pairs = F.arrays_zip("hashes", "counts")
    rows = tagged.filter("fresh and n > 0").select("fp", "n", F.posexplode(pairs).alias("pos", "e")).select("fp", "n", "pos", F.col("e.hashes").alias("h"), F.col("e.counts").alias("often"))
    dealt = F.pmod(F.xxhash64("h", "fp"), 1 + F.floor(F.col("often") / HELD)).cast("int")
    rows = rows.withColumn("part", dealt).repartition("h", "part").dropDuplicates(["h", "part", "fp"])
    along = Window.partitionBy("h", "part").orderBy(F.xxhash64("fp", "h"))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    item = F.struct("fp", "n", "pos")
    beside = F.when(F.pmod("h", F.lit(NEIGHBOURS)) == 0, F.lag(item).over(along))
    rows = rows.select("h", "often", item.alias("x"), F.min(item).over(whole).alias("y"), beside.alias("z"), F.count("*").over(whole).alias("m"))
    # of a frequent hash every row stays, as its other rows may be in other tasks
    rows = tables.write(rows.filter((F.col("m") > 1) | (F.col("often") >= HELD)).select("h", "x", "y", "z"), "near-rows")
    star = rows.select("x", F.explode(F.array_compact(F.array("y", "z"))).alias("y")).filter("x.fp != y.fp").filter(_can("x", "y", share))
    star = star.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
    roots = _grown(None, verifier.verified(simhash_pairs(verifier.sets.filter("n > 0")).unionByName(star)))
    named = _named(rows.select("h", "x"), roots, "x.fp", "root")
    groups = named.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    named = named.join(groups.filter("roots > 1").drop("roots"), "h")
    named = named.join(verifier.sets.select(F.col("fp").alias("_of"), "short"), F.col("x.fp") == F.col("_of")).drop("_of")
    named = tables.write(named, "near-rows")
    other = named.filter("root != main").select("h", F.col("x").alias("y"), F.col("root").alias("root_y"), F.col("short").alias("short_y"))
    close = _close("short", "short_y", F.col("x.n") + F.col("y.n"), share)
    met = named.select("h", "x", "root", "short").join(other, "h").filter((F.col("root") != F.col("root_y")) & _can("x", "y", share) & close)
    later = met.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
    return _grown(roots, verifier.verified(later))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs with one row of each group: least doc_id (null last), of repeated rows one.

    A group is what a chain of links joins; two texts link where at least the share
    of their shingles (words in lower case, each shingle counted once) is common to both.
    Null, empty and blank texts are one group. An empty table gives no rows; other
    columns stay as they are, whatever their names.

    The texts are read where they lie and never shuffled while the dropped rows are few: rows are named by
    two hashes of all their columns (simhash.keyed), and tables between are deleted at the end.
    """
    keyed = simhash.keyed(docs)
    texts = keyed.select("_k1", "_k2", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    with Scratch(docs.sparkSession) as tables:
        frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, shingle))  # MOST pairs of numbers
        tagged = tables.write(_tagged(texts, shingle, _prefix(frequent, share)), "near-tags")
        frequent.destroy()
        sets = tagged.filter("fresh").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("parity").alias("parity"), F.first("short").alias("short"), F.min(F.struct("_k1", "_k2")).alias("first"))
        sets = tables.write(sets, "near-sets")
        roots = near_roots(tagged, _Verifier(texts, sets, shingle, share, tables))
        chosen = simhash.chosen_rows(_named(tagged.select("_k1", "_k2", "doc_id", "fp"), roots, "fp", "root"))
    return simhash.with_rows(keyed, chosen, SEND)
