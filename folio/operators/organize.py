"""User rules, destinations, collisions, folder trees and journals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import detection
from folio.plans.sizes import small


def matching_rules(facts: DataFrame, id_col: str, rules: DataFrame) -> DataFrame:
    """``(id_col, rule_id, position, action, value)``: rules whose conditions all hold.

    ``facts`` are long: ``(id_col, field, fact)``. ``rules`` are one row per condition: ``(rule_id, position, field, expected, n_conditions,
    action, value)``. Facts meet conditions in an equi-join on field and value; a rule matches once all its conditions have.
    """
    met = facts.join(small(rules.withColumnRenamed("expected", "fact")), ["field", "fact"])
    by = met.groupBy(id_col, "rule_id", "position", "action", "value", "n_conditions").agg(F.count_distinct("field").alias("n"))
    return by.where("n = n_conditions").select(id_col, "rule_id", "position", "action", "value")


def first_wins(matches: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, action, value, rule_id)``: the first rule by position and id takes its action."""
    best = F.min(F.struct("position", "rule_id", "value")).alias("b")
    return matches.groupBy(id_col, "action").agg(best).select(id_col, "action", F.col("b.value").alias("value"), F.col("b.rule_id").alias("rule_id"))


def suggestions(decisions: DataFrame, pattern: list[str], choice: str, least: int = 3) -> DataFrame:
    """``(pattern, choice, support)`` that users chose ``least`` times or more for a pattern without any other choice."""
    rows = decisions.groupBy(*pattern).agg(F.count("*").alias("support"), F.min(choice).alias(choice), F.count_distinct(choice).alias("kinds"))
    return rows.where((F.col("support") >= least) & (F.col("kinds") == 1)).drop("kinds")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.95, "very_high").when(c >= 0.85, "high").when(c >= 0.65, "medium").otherwise("low")


def collision_names(rows: DataFrame, id_col: str, folder: str, name: str) -> DataFrame:
    """``rows`` with ``final_name``: files that want one name in one folder, whatever its case, get ``_2``, ``_3`` and so on by id."""
    order = Window.partitionBy(F.lower(folder), F.lower(name)).orderBy(id_col)
    out = rows.withColumn("_n", F.row_number().over(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return out.withColumn("final_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def folder_tree(rows: DataFrame, folder: str, size: str) -> DataFrame:
    """``(node, depth, files, bytes)`` of every folder and all above it; each file gives a row per level, combined map-side."""
    parts = F.split(folder, "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("node"), n.cast("long").alias("depth")))
    return rows.select(F.inline(levels), F.col(size).alias("_s")).groupBy("node", "depth").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("_s"), F.lit(0)).cast("long").alias("bytes")
    )


def proposal_diff(before: DataFrame, after: DataFrame, id_col: str, folder: str) -> DataFrame:
    """``(status, files)``: how many destinations were added, removed or changed."""
    a, b = before.select(id_col, F.col(folder).alias("_a")), after.select(id_col, F.col(folder).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, id_col, "full").groupBy(status.alias("status")).agg(F.count("*").alias("files"))


def broken_chain(events: DataFrame, key: list[str], seq: str, tie: str, digest: str, previous: str, span: int = 10_000) -> DataFrame:
    """Events that do not name the digest of the event before them (by ``seq``, then ``tie``), or leave a gap in the sequence.

    A key's events are followed in stretches of ``span`` numbers, so one that holds most of them is many tasks; only the last event of each stretch
    meets the others of its key.
    """
    rows = events.withColumn("_b", F.expr(f"{seq} div {span}"))
    inside = Window.partitionBy(*key, "_b").orderBy(seq, tie)
    last = rows.groupBy(*key, "_b").agg(F.max_by(F.struct(F.col(digest).alias("d"), F.col(seq).alias("s")), F.struct(seq, tie)).alias("_last"))
    before = last.select(*key, "_b", F.lag("_last").over(Window.partitionBy(*key).orderBy("_b")).alias("_edge"))
    own = rows.withColumns({"_d": F.lag(digest).over(inside), "_s": F.lag(seq).over(inside)}).join(before, [*key, "_b"])
    d, s = F.when(F.col("_s").isNull(), F.col("_edge.d")).otherwise(F.col("_d")), F.coalesce("_s", "_edge.s")
    return own.where(s.isNotNull() & (~d.eqNullSafe(F.col(previous)) | (F.col(seq) != s + 1))).select(*events.columns)


# Folders by what a document's name says.
LEAF_WORDS = {
    "Administratif/Factures": ["invoice", "facture", "receipt", "reçu", "recu", "quittance"],
    "Administratif/Banque": ["bank", "banque", "releve", "relevé", "iban", "rib"],
    "Administratif/Assurances": ["assurance", "insurance", "mutuelle"],
    "Administratif/Impôts": ["tax", "impot", "impôt", "fiscal", "fisc"],
    "Administratif": ["contrat", "contract", "cerfa", "admin"],
    "Études": ["school", "cours", "etude", "étude", "homework", "devoir", "université", "universite"],
    "Travail": ["work", "travail", "meeting", "reunion", "réunion", "projet", "client", "chantier", "devis"],
}


def everyday_folder(path: Column, filename: Column, group: Column) -> Column:
    """Where a file of a home folder goes: null where it stays (programs, and unknown files that lie in a folder already)."""
    low = F.lower(filename)
    leaf = F
    for folder, words in LEAF_WORDS.items():
        leaf = leaf.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), f"Documents/{folder}")
    leaf = leaf.otherwise("Documents/Personnel")
    return (
        F.when(detection.is_program(path), None).when(detection.is_installer(filename), "Installateurs").when(group == "image", "Images").when(group == "video", "Vidéos")
        .when(group == "archive", "Archives").when(group.isin("document", "spreadsheet", "presentation"), leaf)
        .when(~path.rlike(r"[/\\\\]"), "À vérifier")
    )


def path_overlap(source: Column, destination: Column) -> Column:
    """How much a move disturbs: one less the share of folders (any case) that both paths have; equal empty paths disturb nothing."""
    a, b = (F.array_distinct(F.filter(F.split(F.lower(c), "/"), lambda p: p != "")) for c in (source, destination))
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / longer)


def weighted_confidence(parts: dict[str, tuple[Column, float]], partial: Column, reviewed: Column) -> Column:
    """The mean of the confidences that are present, by weight; times .85 for partial and .8 for reviewed input; 0 without any."""
    weight = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    total = sum((weight(c, w) for c, w in parts.values()), F.lit(0.0))
    mean = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0)) / total
    return F.when(total == 0, 0.0).otherwise(mean * F.when(partial, 0.85).otherwise(1.0) * F.when(reviewed, 0.8).otherwise(1.0))


def collapse_groups(rows: DataFrame, folder: str, least: int, depth: int = 8) -> DataFrame:
    """``(folder, files, collapsed)``: each folder and the one its files go to, so that none but top folders holds fewer than ``least``.

    Works on one row a folder; each round moves the files of folders that are too small one level up, at most ``depth`` rounds.
    """
    out = rows.groupBy(folder).agg(F.count("*").alias("files")).withColumn("collapsed", F.col(folder))
    for _ in range(depth):
        held = F.sum("files").over(Window.partitionBy("collapsed"))
        up = F.regexp_replace("collapsed", "/[^/]*$", "")
        out = out.withColumn("_n", held).withColumn("collapsed", F.when(F.col("_n") < least, up).otherwise(F.col("collapsed"))).drop("_n")
    return out
