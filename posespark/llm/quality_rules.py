"""Quality rules as a bitmask ledger: every rule once, policies and ablations from the bits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

#: Rules by bit: name, and when a document fails, over the measurements below.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("stutter", "5 * n_stutter > n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: Mapping[str, int] = {
    "base-1": BASE,
    "prose-1": BASE | BIT["symbols"] | BIT["capitals"] | BIT["duplicate_lines"],
    "prose-2": sum(BIT.values()),
}
PRODUCTION = "prose-2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_stutter")

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_LEADS = bytes(range(0xC0, 0x100))


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words within 3-word windows that the text has twice or more, and words equal to the one before."""
    n = len(words)
    if n < 2:
        return 0, 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    stutter = int((ids[1:] == ids[:-1]).sum())
    if n < 4 or len(numbers) == n:
        return 0, stutter
    pair = ids[:-2] * len(numbers) + ids[1:-1]
    if len(numbers) > 2_000_000:  # keeps the product below within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * len(numbers) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum()), stutter


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, _SPACE)
    without = lambda drop: len(solid) - len(solid.translate(None, drop))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    capitals = without(_CAPITALS)
    repeats, stutter = repeat_words(words)
    return (
        len(words), len(solid) - without(_CONTINUATION), without(_SYMBOLS), len(lines) - len(set(lines)), repeats,
        len(lines), capitals + without(_SMALL) + without(_LEADS), capitals, stutter,
    )


def _measured(docs: DataFrame, text: str | None) -> DataFrame:
    """docs with the measurements; text is left out, or is _doc.text where text is None."""
    keep = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text) if text else batch.column("_doc").field("text")
            table = np.array([measure(t) for t in utf8(texts)], dtype=np.int64).reshape(-1, len(MEASURES))
            columns = {f.name: batch.column(f.name) for f in keep}
            yield pa.RecordBatch.from_pydict(columns | {m: pa.array(table[:, k]) for k, m in enumerate(MEASURES)})

    return docs.mapInArrow(run, T.StructType([*keep, *[T.StructField(m, T.LongType()) for m in MEASURES]]))


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement and fail_bits of each document: the ledger to store.

    Null text has no words and no lines, as the empty text. Ties and repeated rows
    are judged alike, each on its own; an empty table gives an empty ledger;
    extra columns are ignored. Nothing is shuffled.
    """
    return _measured(docs.select("doc_id", "text"), "text").withColumn("fail_bits", _bits())


def rejected(policy: str) -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def verdicts(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger under a policy: with base_failed, kept and the policy's name."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return ledger(docs).withColumns({"base_failed": base, "kept": ~(base | rejected(policy)), "policy": F.lit(policy)})


def keep_documents(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """docs without those that the policy rejects; same columns."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    judged = _measured(kept, None).withColumn("fail_bits", _bits())
    return judged.filter(~rejected(policy)).select("_doc.*")


def ablations(entries: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail it, and that it alone rejects.

    One aggregate over the ledger's bits; no text is read again.
    """
    counts = {}
    bits = F.col("fail_bits")
    for name, mask in policies.items():
        for rule, bit in BIT.items():
            if mask & bit:
                counts[f"{name}|{rule}|fail"] = F.count_if(bits.bitwiseAND(F.lit(bit)) != 0)
                counts[f"{name}|{rule}|alone"] = F.count_if(bits.bitwiseAND(F.lit(mask)) == bit)
    one = entries.agg(*[c.alias(k) for k, c in counts.items()])
    rows = [F.struct(F.lit(k.split("|")[0]).alias("policy"), F.lit(k.split("|")[1]).alias("rule"), F.col(f"`{k}`").alias("n_fail"), F.col(f"`{k[:-4]}alone`").alias("n_alone")) for k in counts if k.endswith("|fail")]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_SQL_CASES = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))

ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i > 1 THEN words[i - 1] END AS prev,
  CASE WHEN i <= len(words) - 2 THEN words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS g FROM pos),
cnt AS (SELECT *, CASE WHEN g IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, g) END AS c FROM win),
cov AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words, count(*) FILTER (word = prev) AS n_stutter FROM (
  SELECT doc_id, word, prev, max(c) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 AS hit FROM cnt) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n_dup_lines, 0) AS n_dup_lines,
  coalesce(cov.n_repeat_words, 0) AS n_repeat_words, coalesce(ln.n_lines, 0) AS n_lines,
  length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(cov.n_stutter, 0) AS n_stutter
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST({_SQL_CASES} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
