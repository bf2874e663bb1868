"""Licence scans: digests of canonical texts, joined with the digests of known licences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import utf8
from .license_texts import FIRST_WORDS, FULL, KNOWN, NOTICES

#: Spellings that count as equal, as words of canonical text.
SPELLINGS: Mapping[str, str] = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "favour": "favor", "honour": "honor", "behaviour": "behavior", "authorise": "authorize", "authorised": "authorized",
    "organisation": "organization", "organisations": "organizations", "merchantibility": "merchantability",
    "noninfringment": "noninfringement", "non-infringement": "noninfringement", "copyrights": "copyright",
    "https": "http", "analogue": "analog", "modelling": "modeling", "programme": "program",
}
_WORDS = {a.replace("-", " ").encode(): b.encode() for a, b in SPELLINGS.items() if "-" not in a}
_PAIRS = {tuple(a.encode().split(b"-")): b.encode() for a, b in SPELLINGS.items() if "-" in a}

#: Byte table: A-Z to a-z; what is neither letter, digit nor non-ASCII to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same, but line breaks stay.
_LINES = _PLAIN[:10] + b"\n" + _PLAIN[11:]
_SIGN = "©".encode()


#: Words after "copyright" in sentences of licences, so that a line with them is none about who and when.
_SENTENCE = ("act", "and", "for", "holder", "holders", "in", "interest", "is", "law", "laws", "license", "licenses", "notice", "notices", "of", "or", "owner", "owners", "permission", "protection", "statement", "to", "treaty")
_SENTENCE_WORDS = frozenset(w.encode() for w in _SENTENCE)
#: Most words of a copyright line without a year.
_LINE = 8


def _year(word: bytes) -> bool:
    return len(word) == 4 and word.isdigit()


def _is_copyright(words: list[bytes]) -> bool:
    """Whether a line is a copyright line: it says who and when, not what is allowed."""
    own = words[1:] if words[:1] == [b"portions"] else words
    if own and own[0] in (b"copyright", _SIGN):
        if any(w in (b"c", _SIGN, b"year") for w in own[1:3]) or any(map(_year, own[1:])):
            return True
        return 1 < len(own) <= _LINE and own[1] not in _SENTENCE_WORDS
    return words == [b"all", b"rights", b"reserved"] or (len(words) > 1 and words[0] == b"c" and _year(words[1]))


def canonical(text: bytes | None) -> bytes:
    """Words in lower case without punctuation, copyright lines and variant spellings, joined by spaces.

    A copyright line is a whole line; in a licence written on one line its words stay.
    """
    out: list[bytes] = []
    for line in (text or b"").translate(_LINES).split(b"\n"):
        words = line.split()
        if not _is_copyright(words):
            out.extend(_WORDS.get(w, w) for w in words)
    if any(a in out for a, _ in _PAIRS):
        paired: list[bytes] = []
        for w in out:
            joined = _PAIRS.get((paired[-1], w)) if paired else None
            if joined is None:
                paired.append(w)
            else:
                paired[-1] = joined
        out = paired
    return b" ".join(out)


def digest(text: bytes | None) -> str | None:
    """SHA-256 of the canonical text, in hexadecimal; none where no word is left."""
    plain = canonical(text)
    return hashlib.sha256(plain).hexdigest() if plain else None


def known_digests(spark: SparkSession, texts: Mapping[str, str] = KNOWN, full: Mapping[str, tuple[int, int, str]] = FULL) -> DataFrame:
    """license_digest and license_id of known licence texts, the long ones by their stated digests (any table of these columns serves)."""
    rows = {d: name for name, (_, _, d) in full.items()} | {digest(text.encode()): name for name, text in reversed(list(texts.items()))}
    return spark.createDataFrame([(d, n) for d, n in rows.items() if d], "license_digest string, license_id string")


def scan(docs: DataFrame, known: DataFrame | None = None, inside: Mapping[str, tuple[int, int, str]] | None = None) -> DataFrame:
    """doc_id, n_canonical_words, digest and license_id of every document.

    inside: licences as known_runs() gives them; their identifiers that find() would
    report in the document are added as the column inside, without variants, sorted and joined by commas.

    license_id names the known licence that the entire text is, up to case,
    punctuation, line breaks, copyright lines and equivalent spellings; else null.
    Of several ids for one digest the least is given.

    Null, empty and blank texts, and texts of copyright lines only, have a null
    digest and no licence. Repeated rows are judged alike; an empty table gives no
    rows; extra columns are ignored.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.filter("license_digest is not null").groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    known = F.broadcast(known) if known.count() <= MOST_SENT else known  # then no document moves
    kind = dict(docs.dtypes)["doc_id"]
    names = {} if inside is None else {d: n.partition(":")[0] for n, (_, _, d) in inside.items()}
    search = None if inside is None else _Search(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [canonical(t) for t in utf8(batch.column("text"))]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_canonical_words": pa.array([p.count(b" ") + 1 if p else 0 for p in plain], type=pa.int64()),
                "digest": pa.array([hashlib.sha256(p).hexdigest() if p else None for p in plain], type=pa.string()),
            }
            if search is not None:
                columns["inside"] = pa.array([",".join(sorted({names[d] for d, _, _ in search(p.split())})) for p in plain], type=pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    more = "" if inside is None else ", inside string"
    digests = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_canonical_words long, digest string{more}")
    return digests.join(known, F.col("digest") == F.col("license_digest"), "left").drop("license_digest")


#: Up to so many known digests are sent to every task; a longer table is joined by shuffle.
MOST_SENT = 100_000

#: Base of the hashes of runs of words, odd, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Words of the runs that are looked up: no known licence is shorter.
SHORTEST = 5


class _Runs:
    """Hashes of all runs of some words, from sums of their hashes by powers of the base."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        power, back = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
        if n:
            power[0] = back[0] = 1
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n) * np.cumprod(power), out=self.sums[1:])
        self.back = np.cumprod(back)

    def of(self, m: int) -> np.ndarray:
        """The hash of each run of m words; none where there are fewer."""
        n = len(self.back)
        return (self.sums[m:] - self.sums[: n - m + 1]) * self.back[: n - m + 1] if m <= n else np.empty(0, np.uint64)

    def at(self, a: int, m: int) -> int | None:
        """The hash of the m words from a on; none where there are fewer."""
        return (int(self.sums[a + m]) - int(self.sums[a])) * int(self.back[a]) % (1 << 64) if a + m < len(self.sums) else None


def _run_hash(words: list[bytes]) -> int:
    return int(_Runs(words).of(len(words))[0])


def known_runs(texts: Mapping[str, str] = KNOWN | NOTICES, full: Mapping[str, tuple[int, int, str]] = FULL) -> dict[str, tuple[int, int, str]]:
    """Words, run hash and digest of known licences by identifier."""
    out = {}
    for name, text in texts.items():
        plain = canonical(text.encode())
        words = plain.split(b" ")
        out[name] = (len(words), _run_hash(words), hashlib.sha256(plain).hexdigest())
    return out | dict(full)


def first_runs() -> dict[str, int]:
    """The hash of the first SHORTEST words of the licences of this library, by digest."""
    texts = {digest(t.encode()): canonical(t.encode()) for t in (KNOWN | NOTICES).values()} | {FULL[n][2]: w.encode() for n, w in FIRST_WORDS.items()}
    return {d: _run_hash(plain.split(b" ")[:SHORTEST]) for d, plain in texts.items() if plain.count(b" ") + 1 >= SHORTEST}


class _Search:
    """Known licences in a list of canonical words: (digest, start, end), those inside a longer one left out.

    Runs of SHORTEST words are looked up once; where a licence's first ones stand, the run of its own length is compared. A
    licence whose first words are not known is looked up by all runs of its length.
    """

    def __init__(self, known: Mapping[str, tuple[int, int, str]]):
        firsts = first_runs()
        self.by_first: dict[int, list[tuple[int, int]]] = {}
        self.by_length: dict[int, set[int]] = {}
        for m, h, d in known.values():
            if d in firsts:
                self.by_first.setdefault(firsts[d], []).append((m, h))
            else:
                self.by_length.setdefault(m, set()).add(h)
        self.firsts = np.array(sorted(self.by_first), dtype=np.uint64)
        self.digests = {d for _, _, d in known.values()}

    def __call__(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        runs, places = _Runs(words), []
        short = runs.of(SHORTEST)
        if len(self.firsts) and len(short):
            near = self.firsts[np.minimum(np.searchsorted(self.firsts, short), len(self.firsts) - 1)]
            for a in np.flatnonzero(near == short).tolist():
                places += [(m, a) for m, h in self.by_first[int(short[a])] if runs.at(a, m) == h]
        for m, wanted in self.by_length.items():
            places += [(m, a) for h in wanted for a in np.flatnonzero(runs.of(m) == np.uint64(h)).tolist()]
        found: list[tuple[str, int, int]] = []
        for m, a in sorted(set(places), key=lambda p: (-p[0], p[1])):
            d = hashlib.sha256(b" ".join(words[a : a + m])).hexdigest()
            if d in self.digests and not any(b <= a and a + m <= e for _, b, e in found):
                found.append((d, a, a + m))
        return found


def find(docs: DataFrame, known: Mapping[str, tuple[int, int, str]] | None = None) -> DataFrame:
    """doc_id, license_id, digest, start and end of every known licence inside each document.

    start and end (excluded) count the canonical words of the document. A licence may
    stand at any place in other text; one that lies inside a longer one is left
    out. Hashes of all runs of a known length pick the candidates, SHA-256 decides.
    Documents without a licence have no row; repeated rows are judged alike.
    """
    known = known_runs() if known is None else known
    names = docs.sparkSession.createDataFrame([(d, n) for n, (_, _, d) in known.items()] or [("", "")], "digest string, license_id string")
    names = names.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    search = _Search(known)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, int, int]] = []
            for i, text in enumerate(utf8(batch.column("text"))):
                rows.extend((i, *hit) for hit in search(canonical(text).split()))
            at, found, starts, ends = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(at, type=pa.int64())),
                "digest": pa.array(found, type=pa.string()),
                "start": pa.array(starts, type=pa.int64()),
                "end": pa.array(ends, type=pa.int64()),
            })

    runs = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest string, start long, end long")
    return runs.join(names, "digest").select("doc_id", "license_id", "digest", "start", "end")


def _oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    line = r"trim(regexp_replace(line, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    words = "regexp_split_to_array(p, ' ')"
    own = "(portions )?(copyright|©)"
    about = " OR ".join(f"regexp_matches(p, '^{r}')" for r in (own + "( [^ ]+)? (c|©|year)( |$)", own + "( .*)? [0-9]{4}( |$)", "c [0-9]{4}( |$)", "all rights reserved$"))
    short = f"regexp_matches(p, '^{own}( [^ ]+){{1,{_LINE - 1}}}$') AND NOT regexp_matches(p, '^{own} ({'|'.join(_SENTENCE)})( |$)')"
    spelled = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items() if "-" not in a) + " ELSE w END"
    table = ", ".join([f"('{digest(t.encode())}', '{n}')" for n, t in KNOWN.items()] + [f"('{d}', '{n}')" for n, (_, _, d) in FULL.items()])
    whole = ", ".join(f"'{d}'" for _, _, d in FULL.values())
    # licences inside, the longest first: what is found is taken out of the text
    texts = sorted(((canonical(t.encode()).decode(), n.partition(":")[0]) for n, t in (KNOWN | NOTICES).items()), key=lambda x: -x[0].count(" "))
    steps, hits = "i0 AS (SELECT doc_id, ' ' || replace(text, ' ', '  ') || ' ' AS x FROM d)", []
    for k, (plain, name) in enumerate(texts):
        pattern = "' " + plain.replace(" ", "  ") + " '"
        steps += f",\ni{k + 1} AS (SELECT * EXCLUDE (x), contains(x, {pattern}) AS h{k}, replace(x, {pattern}, '|') AS x FROM i{k})"
        hits.append(f"CASE WHEN h{k} THEN '{name}' END")
    inside = f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda h: h IS NOT NULL))), ',')"
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split({low}, chr(10))) AS line, unnest(range(len(string_split({low}, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, {line} AS p FROM l),
k AS (SELECT doc_id, i, unnest({words}) AS w, unnest(range(len({words}))) AS j FROM c WHERE p <> '' AND NOT ({about} OR ({short}))),
d AS (SELECT doc_id, count(*) AS n, regexp_replace(string_agg({spelled}, ' ' ORDER BY i, j), '(^| )non infringement( |$)', '\1noninfringement\2', 'g') AS text FROM k GROUP BY doc_id),
known(license_digest, license_id) AS (VALUES {table}),
{steps},
found AS (SELECT doc_id, {inside} AS inside FROM i{len(texts)})
SELECT documents.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, ' ')) END AS n_canonical_words,
  CASE WHEN d.text IS NOT NULL THEN sha256(d.text) END AS digest, license_id, CASE WHEN sha256(d.text) IN ({whole}) THEN license_id ELSE coalesce(found.inside, '') END AS inside
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN known ON sha256(d.text) = license_digest
"""


#: Whole texts of FULL are found by their digests; inside other text they are beyond it.
ORACLE_SQL = _oracle()
