"""Merkle manifest of a dataset: a tree of digests for each group of rows, one root above all, and proofs.

The climb is `combineByKey` driven by events. A digest that arrives at a frontier joins the other children of
its parent; once as many are there as the sizes of the tree say, the parent's digest arrives one level up. Frontiers that tasks
could not resolve are shuffled by block and merged; the tops of blocks are the next round's events. On the way down
the links from children to parents are followed the other way, and each child takes along what it needs to prove itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, in_order, part_of, place_of, shuffle_partitions

#: Columns that a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes under one frontier, at most: what a task holds for a key.
BLOCK = 1024


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256, in hexadecimal digits, of the values: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def digest(children: Sequence[bytes]) -> bytes:
    """The parent of some digests: SHA-256 of their hexadecimal digits."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def widths(n: int, arity: int, span: int) -> list[int]:
    """Nodes of a tree on each level from one of n nodes up, to its root or to the tops of blocks of span nodes."""
    out = [n]
    while out[-1] > 1 and arity ** len(out) <= span:
        out.append(-(-out[-1] // arity))
    return out


class Frontier:
    """What is known of one block of a tree: digests by level and place, and a payload for each node at its bottom."""

    __slots__ = ("arity", "nodes", "payload", "width")

    def __init__(self, n: int, arity: int, span: int):
        self.arity, self.width = arity, widths(n, arity, span)
        self.nodes: list[dict[int, bytes]] = [{} for _ in self.width]
        self.payload: dict[int, tuple] = {}

    def arrive(self, level: int, place: int, value: bytes) -> None:
        """Takes a child; emits its parent, and so on upwards, as soon as the parent has all the children that its tree's size gives it."""
        self.nodes[level][place] = value
        while level + 1 < len(self.width):
            first = place - place % self.arity
            family = [self.nodes[level].get(k) for k in range(first, min(first + self.arity, self.width[level]))]
            if None in family:
                return
            level, place = level + 1, place // self.arity
            self.nodes[level][place] = digest(family)

    def leaf(self, place: int, value: bytes, payload: tuple) -> Frontier:
        self.payload[place] = payload
        self.arrive(0, place, value)
        return self

    def merge(self, other: Frontier) -> Frontier:
        """Both halves' resolved nodes together; children that waited in either one arrive anew."""
        self.payload.update(other.payload)
        for mine, theirs in zip(self.nodes, other.nodes, strict=True):
            mine.update(theirs)
        for level, theirs in enumerate(other.nodes[:-1]):
            for place, value in theirs.items():
                if place // self.arity not in self.nodes[level + 1]:
                    self.arrive(level, place, value)
        return self

    def rows(self) -> tuple[list[tuple], bytes, bytes]:
        """Payloads by place, all digests from the bottom up, and the top."""
        levels = [[self.nodes[k][p] for p in sorted(self.nodes[k])] for k in range(len(self.width))]
        return [self.payload[p] for p in sorted(self.payload)], b"".join(d for row in levels for d in row), levels[-1][0]


def _combine(nodes: RDD, arity: int, span: int, partitions: int) -> RDD:
    """((tree, n, block), frontier) of events (tree, n nodes on this level, place, digest, payload)."""
    def create(event: tuple) -> Frontier:
        n, place, value, payload = event
        return Frontier(n, arity, span).leaf(place, value, payload)

    keyed = nodes.map(lambda e: ((e[0], e[1], e[2] // span), (e[1], e[2], bytes(e[3]), tuple(e[4]))))
    return keyed.combineByKey(create, lambda f, e: f.leaf(e[1], e[2], e[3]), Frontier.merge, numPartitions=partitions)


def _numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with `place` in their tree, in the order of keys, and `n`, the rows of the tree; offsets come from one row a range partition and tree."""
    rows = in_order(rows, F.col("tree"), *[F.col(k) for k in keys]).withColumn("_part", part_of(F.col("_row"))).withColumn("_at", place_of(F.col("_row")))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n"))
    return rows.join(parts, ["tree", "_part"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before", "_row")


def _climb(nodes: DataFrame, payload: Sequence[str], arity: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, from the bottom up, and the top of each tree (tree, digest)."""
    spark = nodes.sparkSession
    span = arity
    while span * arity <= BLOCK:
        span *= arity
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in nodes.select(*payload).schema]) if payload else T.StructType([])
    rounds, tops = [], []
    while True:
        schema = T.StructType([
            T.StructField("tree", T.StringType()), T.StructField("n", T.LongType()), T.StructField("block", T.LongType()), T.StructField("digest", T.BinaryType()),
            T.StructField("nodes", T.BinaryType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in kinds],
        ])
        events = nodes.select("tree", "n", "place", "digest", F.struct(*[f.name for f in kinds]) if kinds.fields else F.array().alias("payload")).rdd
        width = len(kinds.fields)

        def block_row(item: tuple, width: int = width) -> tuple:
            (tree, n, block), frontier = item
            payloads, digests, top = frontier.rows()
            return (tree, n, block, top, digests, *[[p[k] for p in payloads] for k in range(width)])

        blocks = scratch.write(spark.createDataFrame(_combine(events, arity, span, shuffle_partitions(spark)).map(block_row), schema, verifySchema=False), "merkle")
        rounds.append(blocks)
        tops.append(blocks.filter(F.col("n") <= span).select("tree", "digest"))
        rest = blocks.filter(F.col("n") > span)
        if rest.isEmpty():
            return rounds, reduce(DataFrame.unionByName, tops)
        nodes, kinds = rest.select("tree", F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("block").alias("place"), "digest"), T.StructType([])


def _descend(rounds: list[DataFrame], above: DataFrame, payload: Sequence[str], arity: int) -> DataFrame:
    """Rows (tree, place, digest, proof, subroot, root, *payload) of the bottom's nodes, from what is above each tree's top.

    A proof has a step for each level: the digests left of the node in its family, `|`, those right of it.
    """
    carried = ["proof", "subroot", "root"]
    paths = above.select("tree", F.lit(0).cast("long").alias("block"), *carried)
    span = arity
    while span * arity <= BLOCK:
        span *= arity
    for level in range(len(rounds) - 1, -1, -1):
        blocks = rounds[level]
        extra = list(payload) if level == 0 else []
        here = blocks.join(paths, ["tree", "block"]).select("tree", "n", "block", "nodes", *carried, *extra)
        fields = {f.name: f.dataType.elementType for f in blocks.select(*extra).schema} if extra else {}
        schema = T.StructType([
            T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("proof", T.ArrayType(T.StringType())),
            T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), *[T.StructField(k, v) for k, v in fields.items()],
        ])
        down = here.mapInArrow(_links(arity, span, list(fields)), schema)
        if level == 0:
            return down
        below = down.select("tree", F.col("place").alias("block"), *carried)
        paths = below.unionByName(above.select("tree", F.lit(0).cast("long").alias("block"), *carried).join(rounds[level - 1].filter(F.col("n") <= span).select("tree"), "tree", "left_semi"))
    raise AssertionError("no round")


def _links(arity: int, span: int, payload: list[str]):
    def proofs(n: int, block: int, packed: bytes) -> Iterator[tuple[str, list[str]]]:
        """Digest and steps within the block, for each node at its bottom."""
        levels, at = [], 0
        for k, width in enumerate(widths(n, arity, span)):
            size = arity**k
            first = block * span // size
            count = min(width, (block + 1) * span // size if size < span else block + 1) - first
            levels.append([packed[32 * i : 32 * i + 32].hex() for i in range(at, at + count)])
            at += count
        for i, own in enumerate(levels[0]):
            steps = []
            for k, row in enumerate(levels[:-1]):
                p = i // arity**k
                first = p - p % arity
                steps.append("".join(row[first:p]) + "|" + "".join(row[p + 1 : first + arity]))
            yield own, steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a block at a time: BLOCK rows and their proofs
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                found = list(proofs(one["n"], one["block"], one["nodes"]))
                m, tail = len(found), one["proof"]
                columns = [
                    pa.array([one["tree"]] * m, pa.string()), pa.array(range(one["block"] * span, one["block"] * span + m), pa.int64()), pa.array([d for d, _ in found], pa.string()),
                    pa.array([steps + tail for _, steps in found], pa.list_(pa.string())), pa.array([one["subroot"]] * m, pa.string()), pa.array([one["root"]] * m, pa.string()),
                    *[pa.array(one[p], batch.schema.field(p).type.value_type) for p in payload],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "digest", "proof", "subroot", "root", *payload])

    return run


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and the steps of its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(F.substring_index(step, "|", 1), at, F.substring_index(step, "|", -1)), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's sibling digests, level by level, left to right."""
    return F.sha2(F.translate(F.array_join(proof, ""), "|", ""), 256)


def _built(
    docs: DataFrame, columns: Sequence[str], key: str, group: str, arity: int, presented: Mapping[str, Column], shape: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    if arity < 2:
        raise ValueError("a node needs room for two children")
    given = {c: F.col(c) for c in columns}
    leaf, claimed = leaf_digest(list(given.values())), leaf_digest(list((given | dict(presented)).values()))
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("id"), F.unhex(leaf).alias("digest"), F.unhex(claimed).alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    payload = ["id", "claimed"]
    with Scratch(docs.sparkSession) as scratch:
        trees, tops = _climb(_numbered(rows, ["id", "digest"]), payload, arity, scratch)
        subroots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        crown, root = _climb(_numbered(subroots, ["name"]), ["name"], arity, scratch)
        nothing = F.array().cast("array<string>")
        root = root.select("tree", nothing.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        above = _descend(crown, root, ["name"], arity).select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
        out = _descend(trees, cut(above), payload, arity)
        claimed = F.coalesce(F.lower(F.hex("claimed")), F.col("digest"))
        return cut(shape(out.select(F.col("id").alias(key), F.col("digest").alias("leaf"), claimed.alias("presented_leaf"), "subroot", "root", "place", "proof")))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "lang", arity: int = 2) -> DataFrame:
    """A leaf for each row, a tree for each value of group, a root above the trees, and a proof for each row.

    Returns key, leaf, subroot, root, place (of the leaf in its tree) and proof: from leaf to root, the siblings on the left, `|`, the
    siblings on the right. fold(leaf, proof) equals root for the row as it is, and for no other; proof_digest(proof) names the proof.

    In a tree, leaves ascend by key, every `arity` consecutive nodes become their parent, the last family has what is left, and so on up to
    one node, the subroot; subroots ascend by group, null first, and likewise give the root. Leaves are hashed and sorted by Spark; a key of the
    shuffle is a block of 1,024 nodes, so a group that holds a third of all rows is many keys, and a round climbs ten levels of a binary tree.

    Null values are `-` in a leaf, an empty text is `0:`. Rows with a null key come first; rows equal in the key are in the order of
    their digests, and rows equal in all columns are leaves beside each other, each with its own proof. A tree of one row has its leaf
    as its subroot. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return _built(docs, columns, key, group, arity, {}, lambda rows: rows.drop("presented_leaf"))


def verify(
    docs: DataFrame, presented: Mapping[str, Column], columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "lang", arity: int = 2,
) -> DataFrame:
    """Each row's place in the manifest, and whether the row as it is presented, with some columns replaced, still leads to the root.

    Returns key, leaf, subroot, root, proof_sha256, folded_root (from the presented row's leaf and the proof of the row as it is)
    and verified. Nulls, ties, repeated rows, empty tables and other columns are treated as in manifest(); a presented value of null is `-`.
    """
    def judge(rows: DataFrame) -> DataFrame:
        rows = rows.select(key, "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("presented_leaf"), F.col("proof")).alias("folded_root"))
        return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

    return _built(docs, columns, key, group, arity, presented, judge)


def tampered() -> dict[str, Column]:
    """The columns of a presented row that op11 replaces: n_chars is one more where 7 divides the checksum of doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))}


#: The same by recursion over levels: nodes of all trees, then each leaf's steps, then a fold over them.
ORACLE_SQL = """
WITH RECURSIVE given AS (
    SELECT *, list_reduce([ascii(c) for c in string_split(CAST(doc_id AS VARCHAR), '')], lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295) AS crc
    FROM (SELECT doc_id, source, lang, n_chars, text FROM documents)
), shown AS (
    SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
        coalesce(strlen(text) || ':' || text, '-') AS after, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS kept,
        CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') ELSE coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') END AS claimed
    FROM given
), leaves AS (
    SELECT doc_id, lang, leaf, claimed_leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, sha256(before || kept || after) AS leaf, sha256(before || claimed || after) AS claimed_leaf FROM shown)
), nodes AS (
    SELECT lang, 0 AS level, place, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n
), subroots AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
    SELECT 0 AS level, place, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY level, place // 2, n
), top AS (SELECT digest AS root FROM crown WHERE n = 1), steps AS (
    SELECT l.doc_id, l.leaf, l.place, l.lang, 0 AS stage, own.level, CASE WHEN other.digest IS NULL THEN '|' WHEN other.place > own.place THEN '|' || other.digest ELSE other.digest || '|' END AS step
    FROM leaves l JOIN nodes own ON own.lang IS NOT DISTINCT FROM l.lang AND own.n > 1 AND own.place = l.place >> own.level
    LEFT JOIN nodes other ON other.lang IS NOT DISTINCT FROM l.lang AND other.level = own.level AND other.place = xor(own.place, 1)
    UNION ALL
    SELECT l.doc_id, l.leaf, l.place, l.lang, 1, own.level, CASE WHEN other.digest IS NULL THEN '|' WHEN other.place > own.place THEN '|' || other.digest ELSE other.digest || '|' END
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN crown own ON own.n > 1 AND own.place = s.place >> own.level
    LEFT JOIN crown other ON other.level = own.level AND other.place = xor(own.place, 1)
), proofs AS (SELECT lang, place, list(step ORDER BY stage, level) AS proof FROM steps GROUP BY lang, place), found AS (
    SELECT l.doc_id, l.leaf, s.subroot, top.root, coalesce(p.proof, []) AS proof, l.claimed_leaf
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place CROSS JOIN top
), folded AS (
    SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256,
        list_reduce(proof, lambda node, step: sha256(split_part(step, '|', 1) || node || split_part(step, '|', 2)), claimed_leaf) AS folded_root
    FROM found
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
