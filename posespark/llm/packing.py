"""Packing of tokenised documents into sequences of fixed size, by a grouping genetic algorithm on islands.

Documents are cut into pieces of the sequence size. Whole pieces are sequences as they are; the rest is dealt to blocks of a few thousand pieces. Each
block evolves on several islands, rows that Spark spreads over tasks: a solution's genes are its bins, and crossover puts
whole well-filled bins of one parent into the other, drops the bins that held the same pieces and best-fits what that
displaced. Between epochs the best solution of each island moves to the next one, by a join. Full bins of a block's best
solution stay; the pieces of its emptiest ones are pooled over all blocks and packed again, until one block is left.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import compress, repeat
from operator import is_
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_partitions

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces of a block, islands of a block, epochs between which the best move, solutions of an island, children of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 3, 3, 6, 12
#: Words whose ids a task remembers, at most, in each of two generations, and the longest of them in bytes.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes of text whose words are looked up together.
TOGETHER = 1 << 23
#: Bins of a part of the capacity in room at most stay closed; the others' pieces are pooled, a quarter of a block's at most.
CLOSED, POOLED = 64, 4


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, word by word.

    The tokenizer drops white space before it merges, so the ids of a text are those of its words one after the other. A word of
    Latin letters, with or without marks behind it, is one piece of letters and one of marks, and goes to the merges directly;
    every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.recent, self.older = Tokenizer.from_file(path), {}, {}
        self.merges, self.letters = self.tokenizer.model, {}
        split = lambda text: [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        for c in filter(str.isalpha, map(chr, range(0x41, 0x250))):
            if len(self.tokenizer.normalizer.normalize_str(c)) == 1 and split(f"{c}a{c}") == [split(c)[0] + "a" + split(c)[0]]:
                self.letters[ord(c)] = split(c)[0]
        self.plain = re.compile(f"^(?:([{''.join(map(chr, self.letters))}]+)([.,;:!?]*)|.*)$", re.MULTILINE)

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none). Words are split and told apart by Arrow; only distinct ones are looked up."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._of(words.dictionary.cast(pa.binary()).to_pylist()), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, "<i8", len(ids) + 1, 8 * ids.offset)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        flat = memoryview(data) if data else b""
        return (bytes(flat[a:b]) for a, b in zip(ends, ends[1:]))

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        found = list(map(self.recent.get, words))
        learnt = self._learn(list(compress(words, map(is_, found, repeat(None)))))
        self.recent |= {w: ids for w, ids in learnt.items() if len(w) <= LONGEST}
        return [learnt[w] if ids is None else ids for w, ids in zip(words, found)]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        learnt = {w: ids for w in new if (ids := self.older.get(w)) is not None}
        fresh = [w for w in new if w not in learnt]
        lines = b"\n".join(fresh).decode()
        parts = self.plain.findall(lines) if fresh else []
        stems = "\n".join([p[0] for p in parts]).translate(self.letters).split("\n")
        marks = list({p[1] for p in parts if p[1]})
        behind = {"": b""} | dict(zip(marks, self._whole(marks)))
        rest = []
        for w, stem, (_, mark) in zip(fresh, stems, parts):
            if stem:
                learnt[w] = pack_ids([t.id for t in self.merges.tokenize(stem)]) + behind[mark]
            else:
                rest.append(w)
        return learnt | dict(zip(rest, self._whole([w.decode() for w in rest])))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1)
def encoder_of(path: str | None) -> Encoder:
    """The encoder of a worker, with the words it remembers, for all its tasks."""
    return Encoder(path)


def best_fit(items: Sequence[int], sizes: list[int], bins: np.ndarray, rooms: list[int], capacity: int) -> None:
    """Puts each item, in turn, into the bin that it leaves least room in, or a new one; bins and rooms are changed in place."""
    open_bins: dict[int, list[int]] = {}
    rooms_left = 0  # bit r is set where some bin has r free
    for b, room in enumerate(rooms):
        if room:
            open_bins.setdefault(room, []).append(b)
            rooms_left |= 1 << room
    for i in items:
        size = sizes[i]
        fitting = rooms_left >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms_left ^= 1 << room
            room -= size
        else:
            b, room = len(rooms), capacity - size
            rooms.append(room)
        bins[i], rooms[b] = b, room
        if room:
            open_bins.setdefault(room, []).append(b)
            rooms_left |= 1 << room


class Island:
    """A population of solutions of one block; a solution is the bin of each piece."""

    def __init__(self, sizes: np.ndarray, capacity: int, rng: np.random.Generator):
        self.sizes, self.capacity, self.rng = sizes.astype(np.int64), capacity, rng
        self.plain = self.sizes.tolist()
        self.fullest = -(-int(self.sizes.sum()) // capacity)
        self.slack = self.fullest * capacity - int(self.sizes.sum())

    def rooms(self, bins: np.ndarray) -> np.ndarray:
        return self.capacity - np.bincount(bins, weights=self.sizes).astype(np.int64)

    def cost(self, bins: np.ndarray) -> tuple[int, int]:
        """Bins first, then room in as few of them as can be; less is better."""
        rooms = self.rooms(bins)
        return len(rooms), -int((rooms * rooms).sum())

    def perfect(self, cost: tuple[int, int]) -> bool:
        """All bins are full but one."""
        return cost[0] <= self.fullest and -cost[1] >= self.slack * self.slack

    def seeds(self, n: int) -> list[np.ndarray]:
        """Best fit by falling size, the others by falling size with more and more noise."""
        out = []
        for k in range(n):
            noise = 1 if k == 0 else self.rng.uniform(1 - 0.1 * k, 1 + 0.1 * k, len(self.sizes))
            bins = np.zeros(len(self.sizes), np.int64)
            best_fit(np.argsort(-self.sizes * noise, kind="stable").tolist(), self.plain, bins, [], self.capacity)
            out.append(bins)
        return out

    def child(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of a, the bins of b that share no piece with them, and the other pieces by best fit."""
        rooms = self.rooms(a)
        order = np.argsort(rooms, kind="stable")
        good = order[: max(1, len(order) // 2)]
        taken = np.zeros(len(rooms), bool)
        taken[good[self.rng.random(len(good)) < self.rng.uniform(0.05, 0.4)]] = True
        moved = taken[a]
        of_b = self.rooms(b)
        lost = np.zeros(len(of_b), bool)
        lost[b[moved]] = True
        lost[np.argsort(-of_b, kind="stable")[: 1 + int(self.rng.integers(4))]] = True  # mutation: the emptiest bins, and some others
        lost |= self.rng.random(len(of_b)) < 0.01
        stay = ~lost[b] & ~moved
        bins = np.where(stay, b, np.where(moved, a + len(of_b), -1))
        placed = bins >= 0
        _, bins[placed] = np.unique(bins[placed], return_inverse=True)
        rooms = (self.capacity - np.bincount(bins[placed], weights=self.sizes[placed]).astype(np.int64)).tolist() if placed.any() else []
        rest = np.flatnonzero(~placed)
        rest = rest[np.argsort(-self.sizes[rest] * self.rng.uniform(0.9, 1.1, len(rest)), kind="stable")]
        best_fit(rest.tolist(), self.plain, bins, rooms, self.capacity)
        return np.unique(bins, return_inverse=True)[1]

    def epoch(self, population: list[np.ndarray], children: int) -> tuple[list[np.ndarray], tuple[int, int]]:
        """The population after some children, best first, and the best one's cost; ends early where a solution is perfect."""
        ranked = sorted(((self.cost(p), k, p) for k, p in enumerate(population)), key=lambda r: r[:2])
        for k in range(children):
            if self.perfect(ranked[0][0]):
                break
            first, second = (min(self.rng.integers(len(ranked), size=2)) for _ in range(2))
            born = self.child(ranked[first][2], ranked[second][2])
            cost = self.cost(born)
            if cost < ranked[-1][0] and all(cost != r[0] for r in ranked):
                ranked[-1] = (cost, len(population) + k, born)
                ranked.sort(key=lambda r: r[:2])
        return [r[2] for r in ranked], ranked[0][0]


def _evolve(capacity: int, epoch: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["sizes"], "<u2")
                island = Island(sizes, capacity, np.random.default_rng([seed, epoch, r["island"], r["block"]]))
                if r["population"] is None:
                    population = island.seeds(POPULATION)
                else:
                    population = list(np.frombuffer(r["population"], "<u2").astype(np.int64).reshape(-1, len(sizes)))
                    if r["guest"] is not None:
                        population[-1] = np.frombuffer(r["guest"], "<u2").astype(np.int64)
                population, cost = island.epoch(population, CHILDREN)
                packed = np.stack(population).astype("<u2")
                yield pa.RecordBatch.from_pylist([{
                    "block": r["block"], "island": r["island"], "sizes": r["sizes"], "population": packed.tobytes(), "best": packed[0].tobytes(),
                    "bins": cost[0], "rooms": -cost[1], "done": island.perfect(cost),
                }], schema=_STATE)

    return run


_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("population", pa.binary()), ("best", pa.binary()), ("bins", pa.int64()), ("rooms", pa.int64()), ("done", pa.bool_())])
_STATE_DDL = "block long, island int, sizes binary, population binary, best binary, bins long, rooms long, done boolean"


def evolve(blocks: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """The best solution (block, best: the bin of each piece) of each row (block, sizes), both as 16-bit numbers.

    A block leaves as soon as one of its islands has all bins full but one; the others go on to the next epoch, after the best
    solution of each island has moved to the next island.
    """
    parts = shuffle_partitions(blocks.sparkSession)
    state = blocks.select("block", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"), "sizes", F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("guest"))
    found = []
    for epoch in range(epochs):
        after = cut(state.repartition(parts).mapInArrow(_evolve(capacity, epoch, seed), _STATE_DDL))
        ended = after.groupBy("block").agg(F.max("done").alias("over"), F.max_by("best", F.struct(-F.col("bins"), "rooms", -F.col("island"))).alias("best"))
        if epoch + 1 == epochs:
            found.append(ended.select("block", "best"))
            break
        found.append(ended.filter("over").select("block", "best"))
        going = after.join(ended.filter("not over").select("block"), "block")
        guests = after.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("guest"))
        state = going.join(guests, ["block", "island"]).select("block", "island", "sizes", "population", "guest")
        if ended.filter("not over").isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Each document's ids, the end id after them, in pieces of `capacity`: doc_id, piece, start, length, ids_crc32.

    tokenizer is the path of a file of a tokenizer that drops white space, the same on all machines; without one the public
    word_bpe_49k.json. Null and empty texts have the end id only; long texts become many pieces, repeated rows the same ones again.
    """
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def encoded(texts: pa.Array) -> Iterator[bytes]:
        encoder, end, sizes = encoder_of(tokenizer), pack_ids([END]), pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at, size = 0, 0
        for k, n in enumerate(sizes):
            size += n
            if size > TOGETHER or k + 1 == len(sizes):
                yield from (ids + end for ids in encoder.ids(texts.slice(at, k + 1 - at)))
                at, size = k + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for k, ids in enumerate(encoded(batch.column("text"))):
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    rows.append(k), numbers.append(piece), starts.append(start), lengths.append(min(capacity, n - start))
                    sums.append(crc32(ids[4 * start : 4 * (start + capacity)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], [f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _dealt(loose: DataFrame, n: int, block: int) -> DataFrame:
    """Blocks of the pieces: rows (block, sizes, and an array for each column), each of `block` pieces or up to a quarter more, the last of a task of fewer."""
    each = max(1, -(-n // (block * 4 * shuffle_partitions(loose.sparkSession))))
    names = loose.columns
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("sizes", T.BinaryType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in loose.schema]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(table: pa.Table, k: int) -> pa.RecordBatch:
            sizes = np.asarray(table.column("length"), "<u2").tobytes()
            lists = []
            for name in names:
                values = table.column(name).combine_chunks()
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 20) + k], pa.int64()), pa.array([sizes], pa.binary()), *lists], ["block", "sizes", *names])

        held, k = None, 0
        for batch in batches:
            held = pa.Table.from_batches(([batch] if held is None else [*held.to_batches(), batch]))
            while held.num_rows >= block + block // 4:
                yield row(held.slice(0, block), k)
                held, k = held.slice(block), k + 1
        if held is not None and held.num_rows:
            yield row(held, k)

    return loose.repartition(-(-n // (block * each))).mapInArrow(run, schema)


def _settled(names: list[str], capacity: int, level: int, last: bool):
    """The pieces of a block by its best solution: sequence, offset, and whether the piece is pooled for the next level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sizes = np.frombuffer(batch.column("sizes")[r].as_py(), "<u2").astype(np.int64)
                bins = np.frombuffer(batch.column("best")[r].as_py(), "<u2").astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                fill = np.bincount(bins, weights=sizes).astype(np.int64)
                offset = np.empty_like(sizes)
                offset[order] = ends - sizes[order] - (np.cumsum(fill) - fill)[bins[order]]
                pooled = np.zeros(len(fill), bool)
                if not last:
                    emptiest = np.argsort(fill, kind="stable")
                    held = np.cumsum(np.bincount(bins)[emptiest])
                    pooled[emptiest[(held <= len(sizes) // POOLED) & ((capacity - fill[emptiest]) * CLOSED > capacity)]] = True
                sequence = (level << 56) + (batch.column("block")[r].as_py() << 13) + bins
                yield pa.RecordBatch.from_arrays([*[batch.column(n)[r].values for n in names], pa.array(sequence), pa.array(offset), pa.array(pooled[bins])], [*names, "sequence_id", "offset", "_pooled"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Every piece of every document with its sequence and its place there: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold `capacity` tokens at most. What moves is a row of numbers for each piece, not its text; a task holds one block of pieces
    (4,096, up to a quarter more) and its population. Blocks are dealt evenly whatever the keys. Each level pools at most a quarter of its pieces, in fact
    those of a few bins a block, and the last level is one block, so all but a few sequences are full where the pieces allow it.

    Null texts count as empty: a piece of the end id alone. Null doc_ids are kept. Repeated rows are packed one by one. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    if not 2 <= capacity <= 1 << 12 or not 1 <= block <= 1 << 12:
        raise ValueError("capacity and block are 4,096 at most: a sequence's number has 13 bits for the bin of a block")
    cuts = cut(pieces(docs, capacity, tokenizer))
    names = cuts.columns
    done = [cuts.filter(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    loose, level = cuts.filter(F.col("length") < capacity), 0
    while n := loose.count():
        last = n <= block
        blocks = cut(_dealt(loose, n, block))
        schema = T.StructType([*loose.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_pooled", T.BooleanType())])
        settled = cut(blocks.join(evolve(blocks.select("block", "sizes"), capacity, seed=seed + level), "block").mapInArrow(_settled(names, capacity, level, last), schema))
        done.append(settled.filter("not _pooled").drop("_pooled"))
        loose, level = settled.filter("_pooled").select(*names), level + 1
    return reduce(DataFrame.unionByName, done)
