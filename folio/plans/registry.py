"""Where queries register, and the inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import catalog, index, search
from folio.plans.lineage import kept
from folio.sources.adapters import DOC_TEXT, FACTS, FILES, WATCH, adapted, plain
from folio.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its name, together with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


FILES_SQL = f"WITH files AS ({plain(FILES)})"
WATCH_SQL = f"WITH watch AS ({plain(WATCH)})"
FACTS_SQL = f"WITH facts AS ({plain(FACTS)})"
TEXT_SQL = f"WITH docs AS ({plain(DOC_TEXT)})"
TOKENS_SQL = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2)"
STATES_SQL = f"""{WATCH_SQL}, cut AS (SELECT (min(at_ms) + max(at_ms)) // 2 AS c FROM watch),
  half AS (SELECT * FROM watch WHERE at_ms < (SELECT c FROM cut) QUALIFY row_number() OVER (PARTITION BY root_id, path ORDER BY at_ms DESC, seq DESC) = 1),
  full_state AS (SELECT * FROM watch QUALIFY row_number() OVER (PARTITION BY root_id, path ORDER BY at_ms DESC, seq DESC) = 1)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, FILES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir, DOC_TEXT)


FIELDS = ["filename", "path", "text", "source", "metadata"]


def text_index(spark: SparkSession, sf_dir: str) -> str:
    """The stored index of all files, written by the first search of a session."""

    def write(folder: str) -> None:
        rows = files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), "filename", F.col("parent_path").alias("path"), "text", "source", F.col("lang").alias("metadata"))
        index.build(rows, "doc_id", FIELDS, folder)

    return kept(spark, f"index of {sf_dir}", write)


def asked_tokens(spark: SparkSession, sf_dir: str) -> list[str]:
    """The query that the retrieval examples ask: the first six tokens of the benchmark's first item."""
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    row = first.select(F.slice(search.tokens(F.col("text")), 1, 6).alias("ts")).first()
    return list(row["ts"]) if row else []


def half_time(events: DataFrame) -> int | None:
    """The middle of the events' time; null without events."""
    return events.agg(F.expr("(min(at_ms) + max(at_ms)) div 2")).first()[0]


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The last event of each path before half time, and of each path at all."""
    events = adapted(spark, sf_dir, WATCH)
    last = lambda rows: catalog.latest_by(rows, ["root_id", "path"], ["at_ms", "seq"], ["kind", "byte_size"])
    return last(events.where(F.col("at_ms") < F.lit(half_time(events)).cast("long"))), last(events)
