"""File catalogue: duplicates, inventory, versions and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPE_GROUPS = {
    "document": ("pdf", "docx", "doc", "txt", "md", "rtf", "odt"), "spreadsheet": ("xlsx", "xls", "csv", "ods"),
    "presentation": ("pptx", "ppt", "odp"), "image": ("jpg", "jpeg", "png", "gif", "heic", "webp"),
    "video": ("mp4", "mov", "mkv", "avi"), "archive": ("zip", "tar", "gz", "7z", "rar"),
}


def exact_duplicates(files: DataFrame) -> DataFrame:
    """``(byte_size, digest, members, canonical)`` of digests that more than one file has; the least id is canonical.

    Two numbers per group are combined map-side, members are never gathered. Files without a digest have no duplicates.
    """
    groups = files.where("digest is not null").groupBy("byte_size", "digest").agg(
        F.count("*").alias("members"), F.min("file_id").alias("canonical")
    )
    return groups.where("members > 1")


def duplicate_report(files: DataFrame) -> DataFrame:
    """``(file_id, canonical, is_canonical, members, wasted)``, a row for each file of a duplicate group."""
    own = files.select("file_id", "byte_size", "digest")
    rows = own.join(exact_duplicates(files), ["byte_size", "digest"])
    mine = F.col("file_id") == F.col("canonical")
    wasted = F.when(mine, F.lit(0).cast("long")).otherwise(F.col("byte_size").cast("long"))
    return rows.select("file_id", "canonical", mine.alias("is_canonical"), "members", wasted.alias("wasted"))


def size_collisions(files: DataFrame) -> DataFrame:
    """``(file_id, byte_size, peers)``: files that share their size with others; only they need a digest."""
    shared = files.groupBy("byte_size").agg(F.count("*").alias("peers")).where("peers > 1")
    return files.select("file_id", "byte_size").join(shared, "byte_size").select("file_id", "byte_size", "peers")


def type_group(extension: Column) -> Column:
    """One of seven groups; unknown and missing extensions are ``other``."""
    out, low = None, F.lower(extension)
    for name, members in TYPE_GROUPS.items():
        out = (F if out is None else out).when(low.isin(*members), name)
    return out.otherwise("other")


def scan_metrics(files: DataFrame) -> DataFrame:
    """One row of counts over a scan."""
    return files.agg(
        F.count("*").alias("files"), F.count_distinct("parent_path").alias("folders"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).cast("long").alias("bytes"), F.count("digest").alias("hashed"),
    )


def inventory_page(files: DataFrame, sort: str = "filename", descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in a stable order; missing sort values come last either way. Only a page's rows meet in one task."""
    key = F.lower(sort) if dict(files.dtypes)[sort] == "string" else F.col(sort)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return files.orderBy(order, "file_id").offset(offset).limit(limit)


def latest_by(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The ``values`` of the last row of each key, with how many rows it has; an aggregate that combines map-side."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*key).agg(F.count("*").alias("versions"), last).select(*key, "versions", "_last.*")


def validity_ranges(rows: DataFrame, key: list[str], order: list[str], at: str) -> DataFrame:
    """Type-2 history: ``version``, ``valid_from`` and ``valid_to`` (null while current) of each observation."""
    over = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({
        "version": F.row_number().over(over).cast("long"), "valid_from": F.col(at), "valid_to": F.lead(at).over(over),
    })


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """``(key, status)`` with status created, removed or modified; unchanged rows are left out."""
    stamp_of = F.struct(*stamp).alias("_stamp")
    a, b = before.select(key, stamp_of.alias("_a")), after.select(key, stamp_of.alias("_b"))
    status = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def rename_pairs(removed: DataFrame, created: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """``(before, after)`` keys whose stamp is unique on either side; ambiguous stamps pair with nothing."""

    def alone(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*stamp).agg(F.count("*").alias("_n"), F.min(key).alias(name)).where("_n = 1").drop("_n")

    return alone(removed, "before").join(alone(created, "after"), stamp).select("before", "after")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key, if any, no parent has."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_k"), "left_anti")
