"""Linking mentions of organisations, persons and projects by their names and signals, and users' decisions on the links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.normalise import jaccard, name_parts
from folio.plans.components import components

# Weights of identifiers that exclude each other if they differ, and of other shared signals; mail hosts that anyone uses.
EXCLUSIVE = {"company_identifier": 0.72, "vat_identifier": 0.72, "account_identifier": 0.58, "project_reference": 0.62}
SHARED = {"email": 0.70, "phone": 0.55, "domain": 0.24, "address": 0.14, "customer_identity": 0.22, "date": 0.04, "path_context": 0.03}
GENERIC_HOSTS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "yahoo.fr", "icloud.com", "proton.me", "protonmail.com", "orange.fr", "free.fr", "laposte.net",
)
GENERIC_WEIGHT, EXACT, CORE, SIMILAR = 0.03, 0.62, 0.54, 0.34
AUTO, REVIEW, FUZZY, PER_MENTION = 0.97, 0.50, 0.82, 32


def assessed(pairs: DataFrame, mentions: DataFrame, signals: DataFrame) -> DataFrame:
    """``(a, b, score, decision, evidence)`` of pairs of mentions ``(mention, kind, name)`` with ``signals`` ``(mention, signal, value)``.

    Evidence adds up: the name (equal, equal but for a legal form, or similar words), each signal of which a value is shared. Identifiers that
    both have and do not share forbid a link; different legal forms ask for review. Automatic links need more than the score: a name
    and a company identifier for organisations, a name, address and number for persons, a reference and a customer for projects. Mentions
    of different kinds are never linked. Nothing is decided below the threshold of review.
    """
    named = mentions.select("mention", "kind", name_parts(F.col("name")).alias("n"))
    side = lambda p: named.select(F.col("mention").alias(p), F.col("kind").alias(f"{p}_kind"), F.col("n").alias(f"{p}_n"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    own = lambda p: signals.select(F.col("mention").alias(p), "signal", F.col("value").alias(f"{p}_value"))
    both = pairs.select("a", "b").join(own("a"), "a").join(own("b"), ["b", "signal"])
    same = F.col("a_value") == F.col("b_value")
    met = both.groupBy("a", "b", "signal").agg(F.bool_or(same).alias("shared"), F.min(F.when(same, F.col("a_value"))).alias("value"))
    weights = F.create_map(*[F.lit(x) for pair in {**EXCLUSIVE, **SHARED}.items() for x in pair])
    weight = F.when((F.col("signal") == "domain") & F.col("value").isin(*GENERIC_HOSTS), GENERIC_WEIGHT).otherwise(weights[F.col("signal")])
    total = met.groupBy("a", "b").agg(
        F.sum(F.when(F.col("shared"), weight).otherwise(0.0)).alias("signals"), F.collect_set(F.when(F.col("shared"), F.col("signal"))).alias("held"),
        F.bool_or(~F.col("shared") & F.col("signal").isin(*EXCLUSIVE)).alias("blocked"),
    )
    rows = rows.join(total, ["a", "b"], "left")
    exact, core = F.col("a_n.exact") == F.col("b_n.exact"), F.col("a_n.core") == F.col("b_n.core")
    forms = ~exact & core & F.coalesce(F.col("a_n.form") != F.col("b_n.form"), F.lit(False))
    near = jaccard(F.split("a_n.exact", " "), F.split("b_n.exact", " ")) >= FUZZY
    name = F.when(exact, EXACT).when(forms, 0.0).when(core, CORE).when(near, SIMILAR).otherwise(0.0)
    score = F.least(name + F.coalesce("signals", F.lit(0.0)), F.lit(1.0))
    held = F.coalesce("held", F.array().cast("array<string>"))
    has = lambda s: F.array_contains(held, s)
    fits = exact | (core & ~forms)
    required = (
        F.when(F.col("a_kind") == "organization", fits & (has("company_identifier") | has("vat_identifier"))).when(F.col("a_kind") == "person", exact & has("email") & has("phone"))
        .otherwise(has("project_reference") & has("customer_identity") & (fits | has("address")))
    )
    blocked = F.coalesce("blocked", F.lit(False))
    decision = (
        F.when(F.col("a_kind") != F.col("b_kind"), "unknown").when(blocked, "keep_separate").when((score >= AUTO) & required, "auto_link")
        .when((score >= REVIEW) | forms, "review").otherwise("unknown")
    )
    alike = F.col("a_kind") == F.col("b_kind")
    return rows.select("a", "b", F.when(alike, score).otherwise(0.0).alias("score"), decision.alias("decision"), F.when(alike, F.array_join(F.array_sort(held), ",")).otherwise("").alias("evidence"))


def merge_ends(merges: DataFrame) -> DataFrame:
    """``(other, kept)``: where each merged identity ends when merges ``(kept, other)`` are followed.

    Each identity keeps one merge, that with the least ``kept``, so merges form chains; the classes that they connect come from ``components``, and the
    end of a class is the identity that is merged into nothing, or the least one if its merges come round.
    """
    one = merges.where("kept <> other").groupBy("other").agg(F.min("kept").alias("kept"))
    classes = components(one.select(F.col("other").alias("u"), F.col("kept").alias("v")))
    ends = classes.join(one.select(F.col("other").alias("node")), "node", "left_anti").groupBy("root").agg(F.min("node").alias("kept"))
    rows = classes.join(ends, "root", "left").select(F.col("node").alias("other"), F.coalesce("kept", "root").alias("kept"))
    return rows.where("other <> kept")


def stored_identities(mentions: DataFrame, links: DataFrame, merges: DataFrame, unlinked: DataFrame) -> DataFrame:
    """``(mention, identity, locked)`` after automatic ``links`` ``(a, b)`` and users' decisions.

    An automatic identity is the least of its mentions. A merge ``(kept, other)`` of identities stands for all members and keeps the one that the user chose; of
    several for one identity that with the least ``kept`` counts. Merges are followed to their end, also through identities that were merged before; where they
    come round, or meet in a class that no merge leaves open, the least identity of it stands. A mention in ``unlinked`` gets a locked identity of its own, and what it leaves is locked too; its
    own merges do not move it.
    """
    classes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = mentions.select("mention").join(classes, F.col("mention") == F.col("node"), "left").select("mention", F.coalesce("root", "mention").alias("_auto"))
    chosen = merge_ends(merges).select(F.col("other").alias("_auto"), F.col("kept").alias("_kept"))
    rows = rows.join(chosen, "_auto", "left").join(unlinked.select("mention", F.lit(True).alias("_own")).distinct(), "mention", "left")
    rows = rows.withColumn("_identity", F.coalesce("_kept", "_auto"))
    left = rows.where("_own").select("_identity", F.lit(True).alias("_left")).distinct()
    rows = rows.join(left, "_identity", "left")
    mine = F.coalesce("_own", F.lit(False))
    identity = F.when(mine, F.concat(F.lit("own:"), "mention")).otherwise(F.col("_identity"))
    return rows.select("mention", identity.alias("identity"), (mine | F.coalesce("_left", F.lit(False))).alias("locked"))


def identity_detail(identities: DataFrame, mentions: DataFrame, signals: DataFrame) -> DataFrame:
    """``(identity, mentions, name, signals)``: how many mentions an identity has, the shortest of its names, and its distinct signals as ``signal=value``."""
    rows = identities.join(mentions.select("mention", "name"), "mention")
    names = rows.groupBy("identity").agg(F.count("*").alias("mentions"), F.min(F.struct(F.length("name").alias("n"), "name")).alias("f"))
    held = identities.join(signals, "mention").groupBy("identity").agg(F.array_sort(F.collect_set(F.concat("signal", F.lit("="), "value"))).alias("s"))
    out = names.join(held, "identity", "left")
    return out.select("identity", "mentions", F.col("f.name").alias("name"), F.array_join(F.coalesce("s", F.array().cast("array<string>")), ";").alias("signals"))


def file_relations(mentions: DataFrame, identities: DataFrame, id_col: str, role: Column) -> DataFrame:
    """``(id_col, relation, identity, mentions)``: which identities a file names in which role."""
    return mentions.join(identities, "mention").groupBy(id_col, role.alias("relation"), "identity").agg(F.count("*").alias("mentions"))
