"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.plans.lineage import store
from folio.plans.sizes import split_join

KINDS = ("assign", "access", "hex", "token")
"""In the order in which spans that start together are listed."""

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
WORDS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")
MIXED = (re.compile(r"[0-9]"), re.compile(r"[a-z]"), re.compile(r"[A-Z]"))


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` of every candidate in a whole text, by start and kind; null is empty.

    ``assign``, ``access`` and ``hex`` are the base kinds, leftmost and not overlapping within a kind. ``token``
    is a run of 24 or more key characters with digits and letters of both cases that no base span
    touches; only its ownership decides whether it is reported. Offsets are code points, ends exclusive.
    """
    if not text:
        return []
    found = []
    if WORDS.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append(("assign", m.start(), m.end(), m[2]))
    for m in ACCESS.finditer(text):
        found.append(("access", m.start(), m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append(("hex", m.start(), m.end(), m[0]))
    base = [(s, e) for _, s, e, _ in found]
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if all(p.search(m[0]) for p in MIXED) and not any(a < e and s < b for a, b in base):
            found.append(("token", s, e, m[0]))
    return sorted(found, key=lambda c: (c[1], KINDS.index(c[0])))


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """``(_id, _repo, _owner, spans)`` for every row of ``docs``; values leave the scan as SHA-256 only."""
    slim = docs.select(
        F.col(id_col).alias("_id"), F.col(repo_col).cast("string").alias("_repo"),
        F.col(owner_col).cast("string").alias("_owner"), F.col(text_col).alias("_text"),
    )

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,value:string>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "value"), c, strict=True)) for c in candidates(t)] for t in texts], dtype=object)

    hashed = F.transform(
        look("_text"),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.sha2(c["value"].cast("binary"), 256).alias("value")),
    )
    return slim.select("_id", "_repo", "_owner", hashed.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``(value, n_repos, n_owners, n_docs)`` of every candidate hash over the whole corpus.

    Occurrences are first reduced to one row per value, repository and owner with map-side combining, so a
    value that a third of the corpus repeats arrives as a few rows. A missing repository or owner counts as one.
    """
    uses = found.select("_repo", "_owner", F.explode(F.array_distinct(F.transform("spans", lambda c: c["value"]))).alias("value"))
    per = uses.groupBy("value", "_repo", "_owner").agg(F.count("*").alias("n"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return per.groupBy("value").agg(
        F.count_distinct(name("_repo")).alias("n_repos"), F.count_distinct(name("_owner")).alias("n_owners"),
        F.sum("n").alias("n_docs"),
    )


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source",
    copied: int = 3,
) -> DataFrame:
    """``(id_col, spans)``: one row per row of ``docs`` with its spans, each with a verdict from who owns its value.

    A value seen under one owner is ``live``, under ``copied`` or more owners an ``example`` that is widely copied,
    between them ``shared``. Base spans are reported whatever the verdict; ``token`` spans only while they are
    ``live``. ``spans`` is ``array<struct<kind,start,end,value,n_repos,n_owners,verdict>>`` by start and kind, empty
    where nothing was found. Null and empty texts have none. Texts are read once. Values of a single document need no owners
    looked up; those that very many documents hold meet theirs in a broadcast join.
    """
    found = store(scan(docs, id_col, text_col, repo_col, owner_col).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    shared = store(ownership(found).where("n_docs > 1"), "owners")
    spans = found.where(F.size("spans") > 0).select("_row", F.explode("spans").alias("s")).select("_row", "s.*")
    owned = split_join(spans, shared, ["value"], "n_docs", "left")
    one = F.lit(1).cast("long")
    owned = owned.withColumns({c: F.coalesce(c, one) for c in ("n_repos", "n_owners")})
    judged = owned.withColumn(
        "verdict", F.when(F.col("n_owners") == 1, "live").when(F.col("n_owners") >= copied, "example").otherwise("shared")
    )
    judged = judged.where((F.col("kind") != "token") | (F.col("verdict") == "live"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    entry = F.struct("start", rank.alias("rank"), "end", "kind", "value", "n_repos", "n_owners", "verdict")
    listed = judged.groupBy("_row").agg(F.array_sort(F.collect_list(entry)).alias("_listed"))
    tidy = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["n_repos"].alias("n_repos"), c["n_owners"].alias("n_owners"), c["verdict"].alias("verdict"))
    out = found.select("_row", F.col("_id").alias(id_col)).join(listed, "_row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,n_repos:bigint,n_owners:bigint,verdict:string>>")
    return out.select(id_col, F.coalesce(F.transform("_listed", tidy), none).alias("spans"))


def span_list(spans):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
