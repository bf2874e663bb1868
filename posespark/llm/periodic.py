"""Maximal periodic runs of words, by the runs theorem.

Every run has, under one of the two orders of the alphabet, a longest Lyndon word as its root. The longest Lyndon
word at a place ends before the next suffix that is smaller, so it comes from the next smaller values of the inverse suffix array. A root
is extended to both sides by longest common extensions: suffix array, LCP array and a sparse table of its minima, once for the
words and once for the words backwards. A task works on some documents at a time, as arrays; a document is never cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, utf8

#: A run has this many periods, and this many words, at least.
PERIODS, SHORTEST = 4, 6
#: Words that a task puts into one array, unless one document has more.
TOGETHER = 1 << 17


def suffix_ranks(words: np.ndarray, document: np.ndarray, end: np.ndarray, keep: list[np.ndarray] | None = None) -> np.ndarray:
    """The rank of each suffix of each document, documents one after the other; a suffix ends with its document, the shorter of two comes first.

    By doubling: suffixes that still tie are sorted by the rank of what follows. keep takes the ranks by the first 1, 2, 4... words.
    """
    n = len(words)
    key = document * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    head = np.ones(n + 1, bool)
    head[1:n] = np.diff(key[order]) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    step, tied = 1, np.flatnonzero(~(head[:-1] & head[1:]))
    while len(tied):
        if keep is not None:
            keep.append(rank.copy())
        at = order[tied]
        after = at + step
        follow = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follow
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = np.diff(key) != 0
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        last = np.ones(len(at), bool)
        last[:-1] = new[1:]
        step, tied = step * 2, tied[~(new & last)]
    return rank


def next_smaller(rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next place in the document with a smaller rank, else the document's end.

    Each place jumps over what the place it has reached is known to jump over; what has not arrived after some rounds
    descends through a sparse table of minima.
    """
    n = len(rank)
    reach = np.arange(1, n + 1)
    active = np.arange(n)
    for _ in range(24):
        active = active[reach[active] < end[active]]
        active = active[rank[reach[active]] > rank[active]]
        if not len(active):
            return reach
        reach[active] = reach[reach[active]]
    table = minima(rank)
    for level in range(len(table) - 1, -1, -1):
        fits = reach[active] + (1 << level) <= end[active]
        some = active[fits]
        some = some[table[level][reach[some]] > rank[some]]
        reach[some] += 1 << level
    return reach


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at level k the least of each 2**k consecutive values."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


class Extensions:
    """How many words two places have in common, by the least LCP between their ranks."""

    def __init__(self, words: np.ndarray, document: np.ndarray, end: np.ndarray):
        levels: list[np.ndarray] = []
        self.rank, self.end = suffix_ranks(words, document, end, levels), end
        n = len(words)
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1], order[1:]
        common = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            left, right = a + common, b + common
            inside = np.flatnonzero((left < end[a]) & (right < end[b]) & (document[a] == document[b]))
            same = inside[levels[k][left[inside]] == levels[k][right[inside]]]
            common[same] += 1 << k
        self.table = minima(common)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i on and from j on; i and j differ, j may be the end of i's document."""
        out = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero((i < self.end[i]) & (j < self.end[i]))
        low, high = self.rank[i[open_]], self.rank[j[open_]]
        low, high = np.minimum(low, high), np.maximum(low, high)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            out[open_[some]] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << int(k))])
        return out


def roots(words: np.ndarray, document: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest Lyndon words (place, length) under both orders whose period goes on for two more periods, as some root of every wanted run does."""
    places, lengths = [], []
    for order in (words, words.max() - words):
        place = np.arange(len(words))
        length = next_smaller(suffix_ranks(order, document, end), end) - place
        # of a run of four periods the roots that start in its first period, but for its first word, have two more periods after them
        hope = place + 3 * length <= end
        for ahead in (0, 1):
            place, length = place[hope], length[hope]
            hope = words[place + ahead] == words[place + ahead + length]
        place, length = place[hope], length[hope]
        hope = (words[place + length] == words[place + 2 * length]) & (words[place + 2 * length - 1] == words[place + 3 * length - 1])
        places.append(place[hope]), lengths.append(length[hope])
    return np.concatenate(places), np.concatenate(lengths)


def runs_of(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, sorted; words are the documents' words one after the other, counts their numbers."""
    ends = np.cumsum(counts)
    document = np.repeat(np.arange(len(counts)), counts)
    none = np.empty((0, 4), np.int64)
    if not len(words):
        return none
    place, period = roots(words, document, ends[document])
    if not len(place):
        return none
    # only documents with a root need their extensions
    wanted = np.zeros(len(counts), bool)
    wanted[document[place]] = True
    chosen = wanted[document]
    shift = np.cumsum(chosen) - 1
    place, words, counts = shift[place], words[chosen], counts[wanted]
    number = np.flatnonzero(wanted)
    ends = np.cumsum(counts)
    document = np.repeat(np.arange(len(counts)), counts)
    end = ends[document]
    begin = end - counts[document]
    onward = Extensions(words, document, end).of(place, place + period)
    far = onward >= 2 * period
    place, period, onward = place[far], period[far], onward[far]
    # backwards: the same words in reverse, documents still in order; place i becomes begin + end - 1 - i
    mirror = begin + end - 1 - np.arange(len(words))
    inner = place > begin[place]
    back = np.zeros(len(place), np.int64)
    if inner.any():
        before = place[inner] - 1
        back[inner] = Extensions(words[mirror], document, end).of(mirror[before + period[inner]], mirror[before])
    start, length = place - back, period + onward + back
    keep = length >= np.maximum(SHORTEST, PERIODS * period)
    found = np.stack([number[document[place]], start - begin[place], length, period], axis=1)[keep]
    return np.unique(found, axis=0) if len(found) else none


def _documents(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period) of each text, in order."""
    held: list[list[bytes]] = []

    def solved() -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        counts = np.array([len(w) for w in held], np.int64)
        words = np.fromiter((k for w in held for k in map(known.__getitem__, w)), np.int64, int(counts.sum()))
        runs: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for d, start, length, period in runs_of(words, counts).tolist():
            runs[d].append((start, length, period))
        for d, w in enumerate(held):
            yield w, sorted(runs.get(d, []), key=lambda r: (r[0], r[2]))
        held.clear()

    n = 0
    for text in texts:
        words = (text or b"").split()
        if held and n + len(words) > TOGETHER:
            yield from solved()
            n = 0
        held.append(words)
        n += len(words)
    yield from solved()


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _mapped(docs: DataFrame, columns: list[T.StructField], values: Callable[[list[bytes], list[tuple[int, int, int]], bytes | None], tuple]) -> DataFrame:
    """docs with columns added or replaced by values(words, runs, text)."""
    names = [c.name for c in columns]
    schema = T.StructType([*[f for f in docs.schema if f.name not in names], *columns])
    arrow = pa.schema([(c.name, _ARROW[c.dataType.simpleString()]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            rows = [values(words, runs, text) for text, (words, runs) in zip(texts, _documents(texts))]
            kept = [n for n in batch.schema.names if n not in names]
            added = [pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *added], [*kept, *names])

    return docs.mapInArrow(run, schema)


_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW = {
    "bigint": pa.int64(), "string": pa.string(),
    _RUNS.simpleString(): pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
}


def find_runs(docs: DataFrame) -> DataFrame:
    """docs with `runs`, all maximal runs of its text: first word, number of words, smallest period, in the order of start and period.

    A run has four periods and six words at least, and no neighbouring word goes on with its period. Null, empty and blank texts have none;
    long texts are searched whole, by one task; repeated rows are alike; an empty table gives no rows; a column named runs is replaced.
    """
    return _mapped(docs, [T.StructField("runs", _RUNS)], lambda words, runs, text: ([{"start": s, "length": n, "period": p} for s, n, p in runs],))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs whose texts keep of each run its first period only; the words of a text with runs are joined by single spaces, others stay as they are.

    Null stays null. Rows and columns are treated as in find_runs().
    """
    def collapsed(words: list[bytes], runs: list, text: bytes | None) -> tuple:
        return ((_kept(words, runs) if runs or text is None else text).decode() if text is not None else None,)

    return _mapped(docs, [T.StructField("text", T.StringType())], collapsed).select(*docs.columns)


def report_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods (start, length, period, exponent_milli) and digests of all runs and of the collapsed text.

    Ties go to the least start, then the least period; a text without runs has nulls there and the digest of nothing for its runs. Null texts have
    no words. Rows are treated as in find_runs(); other columns are left out, whatever their names.
    """
    def reported(words: list[bytes], runs: list[tuple[int, int, int]], text: bytes | None) -> tuple:
        listed = sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        return len(runs), *most, most[1] * 1000 // most[2] if runs else None, listed, sha256(_kept(words, runs)).hexdigest()

    columns = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    return _mapped(docs.select("doc_id", "text"), [*columns, T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())], reported).drop("text")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """docs as op13 reads them: where 10 divides the checksum of doc_id, the words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    g = F.expr("_h div 10")
    cut: Column = F.expr("cast(_g % size(_w) as int)")
    period = F.expr("cast(1 + (size(_w) - _a) div (3 + _g % 8) as int)")
    repeated = F.array_join(F.transform(F.col("_w"), lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1))), " ")
    plain = docs.select("doc_id", "text", h.alias("_h"))
    planted = plain.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_g", g)
    planted = planted.withColumn("_a", F.when(F.size("_w") > 0, cut)).withColumn("_p", F.when(F.size("_w") > 0, period))
    return planted.select("doc_id", F.when(F.size("_w") > 0, repeated).otherwise(F.col("text")).alias("text"))
