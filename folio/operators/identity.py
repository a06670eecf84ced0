"""Entity resolution: blocking, candidate pairs, assessment, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.plans.components import components
from folio.plans.sizes import spread

SUFFIX = r" (s a s|s a|sas|sarl|sa|ltd|inc|llc|gmbh)$"
GENERIC_DOMAINS = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com")
WEAK_WINDOW, STRONG_WINDOW, WEAK_LIMIT = 16, 32, 512


def normal_name(name: Column) -> Column:
    """Lower case, other characters than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def core_name(name: Column) -> Column:
    """A normal name without its legal form."""
    return F.regexp_replace(name, SUFFIX, "")


def prepared(occurrences: DataFrame) -> DataFrame:
    """``occurrences`` with ``name``, ``core`` and ``own_domain`` (null where anyone can have it)."""
    out = occurrences.withColumn("name", normal_name(F.col("original_value")))
    return out.withColumns({"core": core_name(F.col("name")), "own_domain": F.when(~F.col("domain").isin(*GENERIC_DOMAINS), F.col("domain"))})


def blocking_keys(occ: DataFrame) -> DataFrame:
    """``(occurrence_key, block, strong)`` of prepared occurrences; missing values give no key."""
    key = lambda kind, c, strong: F.struct(F.concat(F.lit(f"{kind}:"), c).alias("block"), F.lit(strong).alias("strong"))
    keys = F.array(key("name", F.col("name"), False), key("core", F.col("core"), False), key("domain", F.col("own_domain"), False), key("id", F.col("company_identifier"), True))
    return occ.select("occurrence_key", F.inline(keys)).where("block is not null")


def block_sizes(keys: DataFrame) -> DataFrame:
    """``(block, strong, members, skipped)``; weak blocks of more than 512 members say nothing and are skipped."""
    sizes = keys.groupBy("block", "strong").agg(F.count("*").alias("members"))
    return sizes.withColumn("skipped", ~F.col("strong") & (F.col("members") > WEAK_LIMIT))


def _followers(keys: DataFrame) -> DataFrame:
    """``(block, a, b)``: each member with the next 16 (strong block: 32) of its block, by key; a window frame, so a block costs its members times 32.

    Blocks are dealt over as many tasks as the session shuffles to: their bytes say little, as every member makes up to 32 rows.
    """
    used = spread(keys.join(block_sizes(keys).where("not skipped").select("block"), "block"), "block")
    order = Window.partitionBy("block").orderBy("occurrence_key")
    ahead = F.collect_list("occurrence_key").over(order.rowsBetween(1, STRONG_WINDOW))
    near = F.when(F.col("strong"), F.col("ahead")).otherwise(F.slice("ahead", 1, WEAK_WINDOW))
    return used.withColumn("ahead", ahead).select("block", F.col("occurrence_key").alias("a"), F.explode(near).alias("b"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """``(a, b, blocks)``: each member with the next 16 (strong block: 32) of its block, by key, and how many blocks say so; no block is joined with itself."""
    return _followers(keys).groupBy("a", "b").agg(F.count("*").alias("blocks"))


def prioritised_pairs(keys: DataFrame) -> DataFrame:
    """``candidate_pairs`` as ``(a, b, blocks, priority)``, with the priority of the best block that says so: 0 for identifiers, 1 for equal names, 2 for core names, 3 for others."""
    kind = F.substring_index("block", ":", 1)
    rank = F.when(kind == "id", 0).when(kind == "name", 1).when(kind == "core", 2).otherwise(3)
    pairs = _followers(keys).withColumn("_r", rank)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("blocks"), F.min("_r").cast("long").alias("priority"))


def assess(pairs: DataFrame, occ: DataFrame) -> DataFrame:
    """``(a, b, score, decision)``: auto_link, review or keep_separate.

    Different company identifiers forbid a link whatever else agrees; a different legal form alone asks for review.
    """
    side = lambda p: occ.select(F.col("occurrence_key").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("name", "core", "own_domain", "company_identifier")])
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    names = F.when(same("name"), 0.62).when(same("core"), 0.54).otherwise(0.0)
    score = F.least(names + F.when(same("company_identifier"), 0.72).otherwise(0.0) + F.when(same("own_domain"), 0.24).otherwise(0.0), F.lit(1.0))
    clash = F.col("a_company_identifier").isNotNull() & F.col("b_company_identifier").isNotNull() & ~same("company_identifier")
    form = same("core") & ~same("name")
    decision = F.when(clash, "keep_separate").when((score >= 0.97) & same("name") & same("company_identifier"), "auto_link")
    decision = decision.when((score >= 0.5) | form, "review").otherwise("keep_separate")
    return rows.select("a", "b", score.alias("score"), decision.alias("decision"))


def identities(assessed: DataFrame, occ: DataFrame) -> DataFrame:
    """``(occurrence_key, identity)``: classes under automatic links, named by their least member."""
    linked = components(assessed.where("decision = 'auto_link'").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = occ.select("occurrence_key").join(linked, F.col("occurrence_key") == F.col("node"), "left")
    return rows.select("occurrence_key", F.coalesce("root", "occurrence_key").alias("identity"))


def canonical_names(members: DataFrame, occ: DataFrame) -> DataFrame:
    """``(identity, display_name, members)``: the shortest name, ties by text."""
    rows = members.join(occ.select("occurrence_key", "original_value"), "occurrence_key")
    first = F.min(F.struct(F.length("original_value").alias("n"), "original_value"))
    return rows.groupBy("identity").agg(first.alias("f"), F.count("*").alias("members")).select("identity", F.col("f.original_value").alias("display_name"), "members")
