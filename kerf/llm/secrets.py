"""Secret scans with corpus-wide ownership of each candidate.

First every document is scanned for candidates: assignments to secret-like names,
cloud access keys, long hex strings (the base kinds), and private key blocks, signed
web tokens and other long strings of high entropy. Then candidate hashes are
aggregated over the corpus by distinct repositories and owners. A value that many
owners share is a copied example; one that few have is taken as live. The entropy
kind, which alone is weak evidence, is reported only where it is live.

Only hashes and positions are shuffled, never texts. Null text counts as empty.
Repeated rows are scanned each and don't raise the number of owners. A null
repository or owner counts as one of its own. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import map_rows, materialize

#: In the order in which kinds at the same place are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "entropy")
#: At most this many owners for a live value; the next ones are copied examples.
MAX_OWNERS = 2
MIN_ENTROPY = 3.5


def _any_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile("(" + _any_case("password|passwd|secret|token|api_?key") + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
PEM = re.compile("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
JWT = re.compile("(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}")
LONG = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
CANDIDATES = "array<struct<kind:string,start:int,end:int,value:long>>"


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _mixed(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret value) sorted by start, then kind as listed."""
    text = text or ""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A run of 32 or more begins where its run begins, so only these need be looked at.
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", m.start(), m.end(), m[0]) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end(), m[0]) for m in JWT.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in found)
    at, upto = 0, 0
    for m in LONG.finditer(text):
        # Long strings come by their starts, so one walk over both lists tells which touch what is found.
        while at < len(taken) and taken[at][0] < m.end():
            upto = max(upto, taken[at][1])
            at += 1
        if upto <= m.start() and _mixed(m[0]) and entropy(m[0]) >= MIN_ENTROPY:
            found.append(("entropy", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, repository: str | Column, owner: str | Column) -> DataFrame:
    """``row, doc_id, repository, owner, found`` of each row of ``docs``."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"),
        col(repository).alias("repository"), col(owner).alias("owner"),
    )

    def make():  # noqa: ANN202
        def step(cols: dict[str, list]) -> dict[str, list]:
            found = [
                [{"kind": k, "start": a, "end": b, "value": xxhash.xxh64_intdigest(v) - (1 << 63)} for k, a, b, v in candidates(t)]
                for t in cols["text"]
            ]
            return cols | {"found": found}

        return step

    return map_rows(rows, make, f"row long, doc_id long, repository string, owner string, found {CANDIDATES}")


def secret_spans(docs: DataFrame, repository: str | Column = "doc_id", owner: str | Column = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs``.

    ``spans`` is an array of kind, start, end (code points), repositories, owners and
    ``live``. Both are counted over the whole corpus. Where rows have no column of their
    repository, each document counts as one.
    """
    found = materialize(scan(docs, repository, owner), "secrets")
    each = found.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("c"))
    # Distinct first, then counts: both combine on the map side, so a value that is everywhere is no hot key.
    # Structs keep null apart from the empty string. Written, so that Spark can split a value that is everywhere where it joins.
    owned = materialize(
        each.select(F.col("c.value").alias("value"), "repository", "owner").distinct()
        .groupBy("value").agg(F.count_distinct(F.struct("repository")).alias("repositories"), F.count_distinct(F.struct("owner")).alias("owners")),
        "owned",
    )
    live = F.col("owners") <= max_owners
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("c.kind"))
    judged = each.select("row", "c").join(owned, F.col("c.value") == F.col("value")).where((F.col("c.kind") != "entropy") | live)
    span = F.struct(
        F.col("c.start").alias("start"), rank.alias("rank"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), "repositories", "owners", live.alias("live")
    )
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    got = secret_spans(docs)
    count = lambda cond: F.size(F.filter("spans", cond)).cast("long")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["rank"] <= 3)
    return got.select(
        "doc_id",
        count(lambda s: s["kind"] == "assign").alias("n_assign"),
        count(lambda s: s["kind"] == "access").alias("n_access"),
        count(lambda s: s["kind"] == "hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )
