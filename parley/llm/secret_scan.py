"""Secrets in texts, and how widely each one is owned across the corpus.

Texts are scanned once. The values found travel as SHA-256 digests only; a digest is counted over
distinct repositories and distinct owners. What many owners share is a copied example, what one
owner has, and what looks random, is taken for a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from parley.llm.common import beside, staged

# fixed values: the base kinds and their patterns
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
# further kinds, each with a text that every match holds
MORE = {
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "pem": ("PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*")),
    "url": ("://", re.compile(r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@]{1,200}:([^\s/:@]{3,200})@")),
}
#: Found in every text with a match of any kind.
SUSPECT = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA|[0-9a-f]{24}|eyJ|PRIVATE KEY-----|://[^\s/:@]+:"
)
KINDS = ("assign", "access", "hex", *MORE)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A value that so many owners have is a copied example.
SHARED_OWNERS = 3
#: Bits per character below which a value is taken for a placeholder.
LEAST_ENTROPY = 2.0

FOUND = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("digest", StringType()),
        StructField("entropy", DoubleType()),
    ]
)
_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all matches in a whole text, by start, then kind as listed."""
    if not text:
        return []
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                found.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= ACCESS_LENGTH:
                found.append(("access", m.start(), m.end(), m[0]))
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, (part, pattern) in MORE.items():
        if part in text:
            found += [(kind, m.start(), m.end(), m[pattern.groups]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def entropy(value: str) -> float:
    """Bits per character of a value's own characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: Column | None = None,
    owner: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row, key, repository, owner, found (see ``FOUND``).

    By default a document is a repository of its own and its ``source`` is the owner.
    """
    repository = F.col(key) if repository is None else repository
    owner = F.col("source") if owner is None else owner

    def run(texts: list[str | None]) -> list[pa.Array]:
        found = [
            [
                {
                    "kind": k,
                    "start": a,
                    "end": b,
                    "digest": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(),
                    "entropy": entropy(v),
                }
                for k, a, b, v in find(t)
            ]
            for t in texts
        ]
        return [pa.array(found, pa.list_(pa.struct(list(zip(FOUND.fieldNames(), _ARROW)))))]

    rows = docs.select(
        F.col(key).alias("key"),
        repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"),
        F.col(text).alias("t"),
    )
    told = beside(rows, "t", [StructField("found", ArrayType(FOUND))], run)
    # the number of a row is fixed when the rows are stored
    return staged(told.withColumn("row", F.monotonically_increasing_id()), "secret-scan")


def ownership(
    scanned: DataFrame, shared_owners: int = SHARED_OWNERS, least_entropy: float = LEAST_ENTROPY
) -> DataFrame:
    """(digest, repositories, owners, verdict) over the whole corpus; NULL owners count as one.

    Repeats are taken out before anything is counted, first within tasks, so that a value that
    everybody copies is no hot key. Verdicts: ``example`` (many owners, or a placeholder), ``live``
    (one owner), ``unclear`` (between).
    """
    seen = scanned.select("owner", "repository", F.explode("found").alias("f"))
    seen = seen.select("owner", "repository", "f.digest", "f.entropy")
    apart = seen.groupBy("digest", "owner", "repository").agg(F.max("entropy").alias("entropy"))
    by_owner = apart.groupBy("digest", "owner").agg(F.count("*").alias("n"), F.max("entropy").alias("entropy"))
    totals = by_owner.groupBy("digest").agg(
        F.sum("n").alias("repositories"), F.count("*").alias("owners"), F.max("entropy").alias("entropy")
    )
    verdict = (
        F.when((F.col("owners") >= shared_owners) | (F.col("entropy") < least_entropy), "example")
        .when(F.col("owners") == 1, "live")
        .otherwise("unclear")
    )
    return totals.select("digest", "repositories", "owners", verdict.alias("verdict"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every row's matches with verdicts: row, key, found, verdicts (array of digest, verdict).

    NULL and empty texts have no matches; rows with equal keys stay apart; an empty table gives no
    rows; columns other than key, text, repository and owner are not looked at.
    """
    scanned = scan(docs, key, text=text, **options)
    verdicts = ownership(scanned)
    wanted = scanned.select("row", F.explode("found.digest").alias("digest")).distinct()
    ruled = (
        wanted.join(verdicts, "digest")
        .groupBy("row")
        .agg(F.collect_list(F.struct("digest", "owners", "verdict")).alias("verdicts"))
    )
    return scanned.join(ruled, "row", "left")


def joined_spans(found: Column) -> Column:
    """kind:start:end of each match, comma-joined; an empty string for none."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every match that is not a copied example replaced by ``[SECRET]``.

    All rows and columns stay. Verdicts are looked up over the whole table. Only texts that may hold
    a match (``SUSPECT``) are shuffled, to meet their verdicts, and rewritten; all others pass by.
    Overlapping matches become one mark.
    """
    scanned = scan(docs, key, text=text, **options)
    examples = ownership(scanned).filter("verdict = 'example'").select("digest")
    hidden = (
        scanned.select("key", F.explode("found").alias("f"))
        .select("key", "f.digest")
        .join(examples, "digest", "left_anti")
        .groupBy("key")
        .agg(F.collect_set("digest").alias("hide"))
    )

    def rewrite(texts: list[str | None]) -> list[pa.Array]:
        """Texts with what is to be hidden in front, each digest on a line of its own."""
        split = [t.split("\n\n", 1) for t in texts]
        return [pa.array([hide(t, set(first.split("\n"))) for first, t in split], pa.string())]

    # a row goes along as one value, so that its columns may have any name
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    suspect = F.coalesce(F.col("t").rlike(SUSPECT), F.lit(False))
    met = rows.filter(suspect).join(hidden, F.col("k").eqNullSafe(F.col("key")), "left")
    first = F.coalesce(F.array_join("hide", "\n"), F.lit(""))
    met = met.select("row", F.concat(first, F.lit("\n\n"), "t").alias("t"))
    done = beside(met, "t", [StructField("t", StringType())], rewrite)
    every = rows.filter(~suspect).select("row", "t").unionByName(done)
    return every.select(*[(F.col("t") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def hide(text: str, digests: set[str], mark: str = "[SECRET]") -> str:
    """Replace the matches whose value has one of ``digests``."""
    out, at = [], 0
    for _, start, end, value in find(text):
        if hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest() not in digests:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
