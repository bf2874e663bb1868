"""Secret scans with a random forest against false positives. DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: A candidate: so many characters of keys, tokens and encoded bytes in a row, with padding
#: at its end only, so that the name in name=value stays a neighbour of the value.
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Words before and after a candidate that count as its neighbours.
BEFORE, AFTER = 3, 2
#: Documents with a word: so many make it one of the dictionary.
DICTIONARY_DOCS = 5
#: Labelled findings that the forest is fitted on at most, and its shape.
MOST_FINDINGS, TREES, DEPTH, SEED = 50_000, 40, 10, 17
#: A finding is a secret from this probability on.
THRESHOLD = 0.5

#: Words beside secrets, beside harmless tokens, and in paths of examples.
SECRET_WORDS = r"(?i)(secret|token|passw|passwd|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key)"
HARMLESS_WORDS = r"(?i)(commit|sha1|sha256|md5|checksum|digest|uuid|guid|revision|integrity|hash|etag|example|sample|dummy|placeholder)"
EXAMPLE_PATHS = r"(?i)(test|example|sample|fixture|mock|doc|readme|lock)"


_WS = r"[\x20\x09-\x0D]+"
_KEY = SECRET_WORDS.removeprefix("(?i)")
#: A value of 8 characters or more that is assigned to a name with a secret word: in one word, or in the word after the sign.
_VALUE = r"[\"']?([^\x20\x09-\x0D\"',;]{8,})"
_KEYED, _NAMED, _SIGN = rf"(?i){_KEY}[^=:]*[=:]+{_VALUE}", rf"(?i){_KEY}.*[=:][\"']?$", r"^[=:]+[\"']?$"
_SOME_KEYED = rf"(?i){_KEY}[^\x20\x09-\x0D]*[\x20\x09-\x0D]*[=:]"

FEATURES = ("length", "digits", "uppers", "marks", "entropy", "transitions", "pair_odds", "dictionary", "secret_beside", "harmless_beside", "assigned", "example_path")


def _value_at(words: Column, word: Column, i: Column) -> Column:
    """The short value that the word holds, the empty text if none."""
    before = lambda k: F.coalesce(F.get(words, i - k), F.lit(""))
    named = before(1).rlike(_NAMED) | (before(1).rlike(_SIGN) & before(2).rlike(SECRET_WORDS))
    own = F.regexp_extract(word, _KEYED, 2)
    return F.when(own != "", own).when(named, F.regexp_extract(word, f"^{_VALUE}", 1)).otherwise("")


def _found(docs: DataFrame, text: str, path: str) -> DataFrame:
    keyed = F.col(text).rlike(_SOME_KEYED)
    some = docs.filter(F.col(text).rlike(CANDIDATE) | keyed).select("doc_id", F.col(path).alias("path"), F.split(text, _WS).alias("words"), keyed.alias("keyed"))
    held = lambda w, i: w.rlike(CANDIDATE) | (F.col("keyed") & (_value_at(F.col("words"), w, i) != ""))
    at = some.select("doc_id", "path", "words", F.filter(F.transform("words", lambda w, i: F.when(held(w, i), i)), lambda i: i.isNotNull()).alias("at"))

    # slices are taken inside, so that no copy of all words goes with each candidate
    def near(i: Column) -> Column:
        word = F.get("words", i)
        runs = F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0))
        value = _value_at(F.col("words"), word, i)
        split = F.split(word, CANDIDATE, -1)
        return F.struct(
            i.cast("long").alias("word"), (F.size(runs) > 0).alias("run"),
            F.when(F.size(runs) > 0, runs).otherwise(F.array(value)).alias("found"),
            F.when(F.size(runs) > 0, split).otherwise(F.array(F.call_function("substring_index", word, value, F.lit(1)), F.lit(""))).alias("pieces"),
            F.when(F.size(runs) > 0, F.regexp_replace(word, CANDIDATE, " ")).otherwise(F.replace(word, value, F.lit(" "))).alias("rest"),
            F.array_join(F.slice("words", F.greatest(i - (BEFORE - 1), F.lit(1)), F.least(i, F.lit(BEFORE))), " ").alias("before"),
            F.array_join(F.slice("words", i + 2, F.lit(AFTER)), " ").alias("after"),
        )

    each = at.select("doc_id", "path", F.explode(F.transform("at", near)).alias("n")).select("doc_id", "path", "n.*")
    found = each.withColumn("lead", F.element_at(F.split("before", " "), -1)).select("*", F.posexplode("found").alias("nth", "candidate"))
    # what stands right before: the piece of the word, else the word before
    lead = F.concat_ws(" ", "lead", F.get("pieces", F.col("nth")))
    return found.select("doc_id", "word", "nth", "candidate", F.concat_ws(" ", "before", "rest").alias("before"), "after", F.coalesce("path", F.lit("")).alias("path"), lead.alias("lead"), "run")


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, word (number of the word that holds it), nth, candidate, before, after, path and lead of each run of key characters.

    Only texts that hold a candidate are split into words. lead is what stands right before it.
    """
    return _found(docs, text, path).filter("run").drop("run")


def all_candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """candidates(), and the shorter values (8 characters or more) that are assigned to a name with a secret word."""
    return _found(docs, text, path).drop("run")


#: Runs of letters that can be words of the dictionary; a longer one counts in pieces, on either side.
_LETTERS = r"\p{L}{4,40}"
#: Up to so many entries are sent to every task, so that other words never move.
MOST_ENTRIES = 200_000


def _runs(candidate: Column) -> Column:
    """Runs of letters in lower case, cut where a capital follows a small letter."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(candidate, r"(\p{Ll})(\p{Lu})", "$1 $2")), F.lit(_LETTERS), F.lit(0))


def dictionary(docs: DataFrame, least: int = DICTIONARY_DOCS, wanted: DataFrame | None = None) -> DataFrame:
    """The corpus' dictionary: runs of four letters or more, in lower case, that `least` documents have.

    A document counts a word once; counts are partial sums before they are shuffled. Of wanted
    entries (entry) the others are left out before that while these are few.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0)))).alias("entry"))
    if wanted is not None:
        words = words.join(F.broadcast(wanted) if wanted.count() <= MOST_ENTRIES else wanted, "entry", "left_semi")
    return words.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("entry")


_SMALL = "abcdefghijklmnopqrstuvwxyz"
_FROM = _SMALL + _SMALL.upper() + "0123456789"
_TO = "".join("v" if c in "aeiou" else "c" for c in _SMALL) + "U" * 26 + "0" * 10
_PAIRS = [a + b for a in "vcU0-" for b in "vcU0-"]
#: Characters that count by themselves in the entropy; all others count as one.
_ALPHABET = _FROM + "+/_-=.!@#$%&*"


def _classes(candidate: Column) -> Column:
    """Each character's class: vowel, consonant, capital, digit or mark."""
    return F.regexp_replace(F.translate(candidate, _FROM, _TO), "[^vcU0]", "-")


@dataclass
class Detector:
    """A fitted forest with its table of transition odds (a number for each of 25 class pairs)."""

    forest: RandomForestClassificationModel
    odds: dict[str, float]


def features(found: DataFrame, words: DataFrame, odds: dict[str, float]) -> DataFrame:
    """found with the columns FEATURES; words is a dictionary, key columns tell rows apart.

    Everything is counted in the text of the candidate, however long it is; no array of its characters is made.
    Dictionary coverage: share of the candidate's characters in runs of four
    letters or more that are dictionary words; the distinct candidates that hold such runs meet the dictionary in one join.
    """
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    times = lambda ch: n - F.length(F.replace(c, ch, F.lit("")))
    alphabet = F.array(*[F.lit(ch) for ch in _ALPHABET])
    counted = F.aggregate(alphabet, F.struct(F.lit(0.0).alias("h"), F.lit(0).alias("k")), lambda a, ch: F.struct((a["h"] - _plogp(times(ch) / n)).alias("h"), (a["k"] + times(ch)).alias("k")))
    out = found.withColumns({"_counted": counted, "_classes": _classes(c), "_runs": _runs(c)})
    weighed = F.array(*[F.struct(F.lit(f"{p[0]}(?={p[1]})").alias("pair"), F.lit(odds[p]).alias("odds")) for p in _PAIRS])
    total = F.aggregate(weighed, F.lit(0.0), lambda a, w: a + w["odds"] * F.regexp_count(F.col("_classes"), w["pair"]))
    out = out.withColumns({
        "length": n.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share("[^A-Za-z0-9]"),
        "entropy": F.col("_counted.h") - _plogp((n - F.col("_counted.k")) / n),
        "transitions": (F.length(F.regexp_replace("_classes", r"(.)\1+", "$1")) - 1) / n,
        "pair_odds": total / n,
        "secret_beside": F.col("before").rlike(SECRET_WORDS).cast("double"),
        "harmless_beside": F.concat_ws(" ", "before", "after").rlike(HARMLESS_WORDS).cast("double"),
        "assigned": F.col("lead").rlike(r"[=:][\x20\x09-\x0D]*[\"'(\[]?[\x20\x09-\x0D]*$").cast("double"),
        "example_path": F.col("path").rlike(EXAMPLE_PATHS).cast("double"),
    }).drop("_counted", "_classes")
    worded = out.filter(F.size("_runs") > 0)
    entries = worded.select("candidate", "_runs").distinct().select("candidate", F.explode("_runs").alias("entry"))
    covered = entries.join(words, "entry").groupBy(F.col("candidate").alias("_of")).agg(F.sum(F.length("entry")).alias("_known"))
    worded = worded.join(covered, F.col("candidate") == F.col("_of"), "left").withColumn("dictionary", F.coalesce("_known", F.lit(0)) / n).drop("_of", "_known")
    return worded.unionByName(out.filter(F.size("_runs") == 0).withColumn("dictionary", F.lit(0.0))).drop("_runs")


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def transition_odds(findings: DataFrame) -> dict[str, float]:
    """Log odds of each pair of character classes in secrets against harmless candidates."""
    pairs = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(f"{p[0]}(?={p[1]})").alias("pattern")) for p in _PAIRS])
    each = findings.select("label", _classes(F.col("candidate")).alias("c"), F.explode(pairs).alias("p"))
    sums = each.groupBy("label", "p.pair").agg(F.sum(F.regexp_count("c", "p.pattern")).alias("n")).collect()  # 2 * 25 rows
    seen = {(r["label"], r["pair"]): r["n"] for r in sums}
    counts = {y: {p: seen.get((y, p), 0) + 1 for p in _PAIRS} for y in (0, 1)}
    total = {y: sum(counts[y].values()) for y in (0, 1)}
    return {p: log(counts[1][p] / total[1]) - log(counts[0][p] / total[0]) for p in _PAIRS}


def fit(findings: DataFrame, words: DataFrame, most: int = MOST_FINDINGS) -> Detector:
    """Fits the forest on labelled findings: candidate, before, after, path, lead (what stands right before) and label (1: a secret).

    Without a column lead, before serves. Of more than `most` findings those with the least hashes serve.
    """
    if "lead" not in findings.columns:
        findings = findings.withColumn("lead", F.col("before"))
    chosen = cut(findings.filter(F.col("label").isin(0, 1) & F.col("candidate").isNotNull()).orderBy(F.xxhash64(F.lit(SEED), "candidate", "before"), "candidate").limit(most))
    odds = transition_odds(chosen)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(chosen, words, odds))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", subsamplingRate=0.7)
    return Detector(forest.fit(rows.withColumn("label", F.col("label").cast("double")).select("features", "label")), odds)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """Every candidate of every document: doc_id, word, nth, candidate, score and is_secret.

    The score is the forest's probability that a candidate is a secret; below the
    threshold it is a false positive. Candidates come from whole texts: runs of key characters, and shorter
    values that are assigned to a name with a secret word.

    findings: labelled findings as fit() takes them; without, those of labelled_findings() serve.
    Null and empty texts have no candidates; a null path counts as empty; of a null
    doc_id and of repeated rows the candidates are listed like any other; a very long candidate is
    one candidate. An empty table gives no rows; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.col(path).cast("string").alias("source"))
    findings = labelled_findings(docs.sparkSession) if findings is None else findings
    found = cut(all_candidates(docs))
    # only runs of letters that some candidate holds are looked up
    entries = found.select("candidate").unionByName(findings.select("candidate"))
    entries = cut(entries.select(F.explode(_runs(F.col("candidate"))).alias("entry")).distinct())
    words = cut(dictionary(docs, wanted=entries))
    detector = fit(findings, words)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found, words, detector.odds))
    judged = detector.forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return judged.select("doc_id", "word", "nth", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def labelled_findings(spark: SparkSession, n: int = 12_000, seed: int = SEED) -> DataFrame:
    """Labelled findings made by rule, for use where no labelled table is at hand.

    The shape of the candidate, the words beside it and the path are drawn apart from each other:
    keys stand in plain prose too, and words, paths, identifiers and placeholders stand beside
    secret words. Random keys are secrets unless a digest or a revision is named beside them; hexadecimal
    tokens and UUIDs only where a secret is named; in paths of examples only what is assigned to a name.
    """
    def pick(k: int, m: int) -> Column:
        return F.pmod(F.get("drawn", F.lit(k)), F.lit(m))

    def draw(k: int, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (pick(k, len(values)) + 1).cast("int"))

    base = spark.range(n).select("id", F.sha2(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")), 512).alias("sha"))
    base = base.select("id", "sha", F.translate(F.base64(F.unhex("sha")), "\r\n", "").alias("b64"))
    base = base.withColumn("drawn", F.transform(F.sequence(F.lit(0), F.lit(160)), lambda k: F.xxhash64(F.lit(seed), k, "id")))
    sha, b64 = F.col("sha"), F.col("b64")
    url64 = F.translate(b64, "+/=", "-_a")
    size = (pick(1, 24) + 20).cast("int")
    few = (pick(30, 9) + 8).cast("int")
    syllables = ["the", "ing", "tion", "er", "an", "re", "ment", "est", "al", "ver", "con", "ous", "der", "sch", "que", "eau", "ka", "li", "mo", "su"]
    word = F.concat(*[draw(100 + k, syllables) for k in range(7)])
    short = F.concat(*[draw(150 + k, syllables) for k in range(4)])
    nouns = ["get", "user", "data", "file", "node", "list", "index", "value", "handler", "config", "page", "token", "password", "secret", "key"]
    parts = [draw(120 + k, nouns) for k in range(4)]
    random = [  # kind 2
        F.substring(b64, 1, 40), F.substring(b64, 7, 44), F.substr(b64, F.lit(2), size), F.substr(url64, F.lit(2), size),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(b64, "+/=", "aZ9"), 5, 16))), F.concat(draw(2, ["ghp_", "sk_live_", "xoxb-", "key-", "pk_", ""]), F.translate(F.substring(b64, 3, 36), "+/=", "aZ9")),
        F.concat(F.lit("eyJ"), F.substring(url64, 1, 60)), F.upper(F.substr(F.translate(b64, "+/=", "aZ9"), F.lit(4), size)),
    ]
    hexes = [F.substring(sha, 1, 40), F.substring(sha, 3, 32), F.substring(sha, 1, 64), F.substr(sha, F.lit(9), size), F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(sha, 17, 4), F.substring(sha, 21, 12))]  # kind 1
    calm = [  # kind 0
        word, F.initcap(word), F.upper(word), F.concat_ws("_", *parts), F.upper(F.concat_ws("_", *parts)), F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat_ws("-", short, word),
        F.repeat(draw(3, ["=", "-", "_", "x", "0", "ab", "1234", "A"]), 20), F.concat_ws("/", draw(4, ["src", "usr", "home", "lib", "docs"]), word, draw(5, ["main", "bin", "data", "overview-page"])),
        F.concat(draw(6, ["your", "my", "EXAMPLE", "INSERT"]), F.lit("_"), draw(7, ["api_key_here", "SECRET_TOKEN", "password_goes_here"])),
        F.concat(F.lit("20"), F.conv(F.substring(sha, 1, 12), 16, 10)), F.concat_ws("-", F.lit("2023"), F.substring(F.conv(F.substring(sha, 1, 10), 16, 10), 1, 6), short, short),
    ]
    values = [F.substr(F.translate(b64, "+/=", "!@#"), F.lit(3), few), F.concat(short, F.substring(F.conv(F.substring(sha, 1, 8), 16, 10), 1, 3), draw(40, ["!", "$", "", "#"])), F.concat(F.initcap(draw(41, syllables)), F.substring(F.translate(b64, "+/=", "$.?"), 9, 7))]  # kind 3, secrets
    dummies = [short, F.concat(F.lit("${"), F.upper(short), F.lit("}")), F.concat(F.lit("<"), short, F.lit(">")), draw(42, ["changeme", "xxxxxxxx", "********", "required", "undefined", "password", "optional"]), F.concat(F.lit("os.environ["), short, F.lit("]")), F.concat(F.lit("get_"), short, F.lit("()")), F.concat(short, F.lit("."), short)]  # kind 4
    shapes = [(2, x) for x in random] + [(1, x) for x in hexes] + [(0, x) for x in calm] + [(3, x) for x in values] + [(4, x) for x in dummies]
    contexts = [  # name, (before, what leads)
        ("named", ["token =", "secret:", "api_key =", "password =", "Authorization: Bearer", "access_key:", "auth token =", "client secret =", "PASSWORD=", "api-key:"]),
        ("spoken", ["the token", "my password", "this secret", "password reset", "a bearer", "private key", "use token"]),
        ("digest", ["commit", "sha256", "checksum =", "md5:", "revision", "integrity:", "token commit", "secret checksum =", "etag:", "at revision"]),
        ("prose", ["of the", "see also", "in", "and with", "then we met", "near", "a long"]), ("prose", ["called", "from", "over the", "it was", "by", "for"]),
        ("set", ["value =", "name:", "id =", "path:", "title =", "url:", "x ="]),
    ]
    chosen, which = pick(0, len(shapes)).cast("int"), pick(8, len(contexts)).cast("int")
    kind = F.get(F.array(*[F.lit(y) for y, _ in shapes]), chosen)
    candidate = F.get(F.array(*[x for _, x in shapes]), chosen)
    rows = cut(base).select("id", "drawn", kind.alias("kind"), candidate.alias("candidate"), which.alias("which"), draw(13, ["src3", "app/main", "src0", "config/prod", "web", "tests/data", "docs/example", "", "blog", "news"]).alias("path"))
    rows = rows.withColumn("which", F.when(F.col("kind") >= 3, 0).otherwise(F.col("which")))  # short values are found beside a name only
    rows = rows.withColumns({
        "named": F.get(F.array(*[F.lit(name) for name, _ in contexts]), F.col("which")),
        "near": F.get(F.array(*[draw(60 + k, texts) for k, (_, texts) in enumerate(contexts)]), F.col("which")),
    })
    label = (
        F.when(F.col("kind") == 3, 1).when(F.col("kind") == 2, (F.col("named") != "digest").cast("int"))
        .when(F.col("kind") == 1, ((F.col("named") == "named") | ((F.col("named") == "spoken") & (pick(50, 5) < 4))).cast("int")).otherwise(0)
    )
    label = F.when(F.col("path").rlike(EXAMPLE_PATHS) & ~((F.col("kind") >= 2) & (F.col("named") == "named")), 0).otherwise(label)
    quote = draw(11, ["\"", "'", "", ""])
    lead = F.concat(F.element_at(F.split("near", " "), -1), F.lit(" "), quote)
    return rows.select(
        "candidate", F.concat_ws(" ", draw(10, ["", "the of", "and that", "in export", "set"]), "near", quote).alias("before"),
        draw(12, ["", "and the", "for this", "was then"]).alias("after"), "path", lead.alias("lead"), label.cast("int").alias("label"),
    )
