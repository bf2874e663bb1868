"""Cross-site boilerplate removal by the spread of lines over distinct sites."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 8
#: log2 of the sketch's registers; its relative error is 1.04 / sqrt(2**LG_K) at most.
LG_K = 10
#: Estimates within this share of MIN_SITES are settled by an exact count (over 3 errors).
NEAR = 0.2
#: A line with more than one in so many of all lines is heavy; fewer than that many lines are.
HEAVY = 1000

_SPACES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_STRIP = " \t\n\r\x0b\x0c"
_SECOND_SEED = 7


def _hashes(line: Column) -> list[Column]:
    """128 bits of a line: two chained 64-bit hashes."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(_SECOND_SEED), line).alias("h2")]


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, site and the hashes of each line that has a word, ends trimmed."""
    site = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("site")
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), site, F.explode(F.split("text", "\n")).alias("line"))
    trimmed = lines.select("doc_id", "text_hash", "site", F.regexp_replace("line", _SPACES, "").alias("line")).filter("line != ''")
    return trimmed.select("doc_id", "text_hash", "site", *_hashes(F.col("line")))


def line_spread(keys: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """h1, h2, boilerplate and heavy of lines that are near min_sites distinct sites or above, or heavy.

    Every task sketches the sites of its lines (HyperLogLog) and the sketches of a
    line merge in the aggregation, so that a line on every page moves one sketch a
    task. Estimates away from the threshold decide; lines near it get exact counts
    of distinct sites, from (line, site) pairs that are made distinct before they move.
    """
    total = keys.count()
    spread = keys.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"))
    # fewer lines than sites asked for cannot reach them, whatever the sketch says
    heavy = F.col("n") * HEAVY > total
    spread = spread.filter((F.col("n") >= min_sites) | heavy).select("h1", "h2", heavy.alias("heavy"), F.hll_sketch_estimate("sketch").alias("sites"))
    spread = cut(spread.filter((F.col("sites") >= (1 - near) * min_sites) | F.col("heavy")))
    close = spread.filter(F.col("sites").between((1 - near) * min_sites, (1 + near) * min_sites))
    # not a semi join: that would be moved below distinct, and all rows of a line with it
    pairs = keys.select("h1", "h2", "site").distinct().join(close.select("h1", "h2"), ["h1", "h2"])
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    judged = spread.join(exact, ["h1", "h2"], "left")
    return cut(judged.select("h1", "h2", "heavy", (F.coalesce("exact", "sites") >= min_sites).alias("boilerplate")))


def boilerplate_lines(keys: DataFrame, spread: DataFrame) -> DataFrame:
    """doc_id, text_hash, h1, h2 of the rows of keys that are boilerplate.

    Heavy lines (fewer than HEAVY) are sent to every task, so that their rows stay
    where they are; only the rows of other lines move to meet their line.
    """
    heavy = F.broadcast(spread.filter("heavy").select("h1", "h2", F.col("boilerplate").alias("known")))
    marked = keys.select("doc_id", "text_hash", "h1", "h2").join(heavy, ["h1", "h2"], "left")
    light = spread.filter("boilerplate and not heavy").select("h1", "h2")
    rest = marked.filter("known is null").join(light, ["h1", "h2"], "left_semi")
    return marked.filter("known").unionByName(rest).select("doc_id", "text_hash", "h1", "h2")


def _line_hashes(line: str) -> tuple[int, int]:
    """What _hashes gives for one trimmed line, as signed 64-bit numbers."""
    data = line.encode()
    first = xxhash.xxh64_intdigest(data, 42)
    seed = xxhash.xxh64_intdigest(_SECOND_SEED.to_bytes(4, "little"), 42)
    second = xxhash.xxh64_intdigest(data, seed)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (first, second))  # type: ignore[return-value]


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_lines": [], "n_removed": [], "text": []}
        for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            drop = {(b["h1"], b["h2"]) for b in bad or ()}
            kept = [x for x in lines if not (s := x.strip(_STRIP)) or _line_hashes(s) not in drop] if drop else lines
            out["n_lines"].append(len(lines))
            out["n_removed"].append(len(lines) - len(kept))
            out["text"].append(None if text is None else "\n".join(kept))
        kinds = {"n_lines": pa.int64(), "n_removed": pa.int64(), "text": pa.string()}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, type=kinds[k]) for k, v in out.items()})


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """doc_id, n_lines, n_removed and the text without boilerplate lines, for each document.

    A site is a value of `source`. Lines are compared without white space at their
    ends; lines without a word are never removed. The lines' hashes are written once
    to the shared folder, and deleted when the boilerplate of each document is known. A document's boilerplate lines are gathered by doc_id and
    hash of the text (as many as the document has lines), never a line's documents;
    texts move once, to meet them.

    Null text stays null with no lines; null source is a site of its own; documents
    without id, or that share one, each lose their own boilerplate lines. A
    document of boilerplate only becomes the empty text. An empty table gives no
    rows; extra columns are ignored.
    """
    docs = docs.select("doc_id", "source", "text")
    with Scratch(docs.sparkSession) as tables:
        keys = tables.write(line_keys(docs), "lines")
        found = boilerplate_lines(keys, line_spread(keys, min_sites, lg_k, near))
        per_doc = cut(found.distinct().groupBy(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("h1", "h2")).alias("bad")))
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.xxhash64("text") == F.col("_hash"))
    met = docs.select("doc_id", "text").join(per_doc, same, "left")
    kind = dict(docs.dtypes)["doc_id"]
    return met.select("doc_id", "text", "bad").mapInArrow(_without, f"doc_id {kind}, n_lines long, n_removed long, text string")


ORACLE_SQL = rf"""
WITH lines AS (SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, regexp_replace(line, '{_SPACES}', '', 'g') AS k FROM lines),
bad AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}),
r AS (SELECT doc_id, i, line, k IN (SELECT k FROM bad) AS gone FROM t),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, g.text AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
