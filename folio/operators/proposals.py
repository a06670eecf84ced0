"""Proposals of where files should go: policy, small groups, collisions, tree, summary and difference; built whole or from what changed."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import pathfit
from folio.operators.normalise import collision_key, component_fault, generic_name, parent_parts
from folio.operators.organize import confidence_band, weighted_confidence
from folio.plans.lineage import store, store_by
from folio.plans.prefix import running_total
from folio.plans.sizes import hashed, small, split_join

TO_REVIEW = "TO_REVIEW"
HIGH, LOW = 0.85, 0.65
DIRTY_LIMIT = 512
"""Changed files up to which a proposal is built from what changed, if the caller sets no other limit; ``incremental`` itself has none."""

# Folders by type of document, areas of other business papers, names in file names, types that have a useful year.
TYPE_FOLDERS = {
    "invoice": "Invoices", "quote": "Quotes", "contract": "Contracts", "employment_contract": "Contracts", "receipt": "Receipts", "photo": "Photos",
    "video": "Videos", "purchase_order": "Purchase Orders", "delivery_note": "Delivery Notes", "tax_document": "Taxes",
    "bank_statement": "Bank Statements", "payslip": "Payroll", "legal_document": "Legal", "administrative_document": "Administration",
}
AREAS = {
    "invoice": "Accounting", "receipt": "Accounting", "purchase_order": "Accounting", "delivery_note": "Accounting", "bank_statement": "Accounting",
    "tax_document": "Accounting", "contract": "Legal", "legal_document": "Legal", "payslip": "HR", "employment_contract": "HR", "cv": "HR",
}
PERSONAL = {
    "tax_document": ["Administrative", "Taxes"], "insurance_document": ["Administrative", "Insurance"], "bank_statement": ["Administrative", "Banking"],
    "photo": ["Photos"], "video": ["Videos"], "archive": ["Archives"],
}
SINGULAR = {
    "invoice": "Invoice", "quote": "Quote", "contract": "Contract", "receipt": "Receipt", "purchase_order": "Purchase-Order", "delivery_note": "Delivery-Note",
    "tax_document": "Tax", "bank_statement": "Bank-Statement", "payslip": "Payslip", "photo": "Photo", "video": "Video",
}
DATED = ("invoice", "contract", "receipt", "tax_document", "payslip", "bank_statement", "photo", "video")
SEMANTIC_ROOTS = ("business", "entreprise", "professional", "professionnel", "personal", "personnel")


@dataclass(frozen=True)
class Preferences:
    """A user's choices."""

    client_first: bool = True
    year_folders: bool = True
    photos_in_projects: bool = True
    supplier_invoices_in_projects: bool = True
    preserve_folders: bool = True
    least_group: int = 2
    depth: int = 6
    personal_root: str = "Personal"
    business_root: str = "Business"
    review_below: float = 0.65


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def _part(value: Column | str, optional: bool = False) -> Column:
    """One folder of a destination, or nothing where its name is null."""
    c = F.lit(value) if isinstance(value, str) else value
    return F.when(c.isNotNull(), F.array(F.struct(c.alias("name"), F.lit(optional).alias("optional")))).otherwise(F.array().cast("array<struct<name:string,optional:boolean>>"))


def policy(p: Preferences) -> Column:
    """The folders ``(name, optional)`` of a file by its ``context, document_type, customer, supplier, project``, ``date``, ``rule`` and ``rule_years``.

    Personal files go by their type, business files by client, project or supplier first, or by type first; years and types below them are
    optional and fall away in small groups. Other contexts are to be reviewed.
    """
    kind, customer, supplier, project = (F.col(c) for c in ("document_type", "customer", "supplier", "project"))
    dated = kind.isin(*DATED) & F.coalesce(F.col("rule_years"), F.lit(p.year_folders)) & F.col("date").rlike("^(19|20|21)[0-9]{2}-.{2}-.{2}$|^2200-.{2}-.{2}$")
    year = _part(F.when(dated, F.substring("date", 1, 4)), True)
    within = F.lit(p.supplier_invoices_in_projects) & (kind == "invoice") & supplier.isNotNull() & project.isNotNull()
    folder = F.when(within, "Supplier Invoices").otherwise(_named(kind, TYPE_FOLDERS))
    area = F.coalesce(_named(kind, AREAS), F.lit("Administration"))
    private = F.lit(None).cast("array<struct<name:string,optional:boolean>>")
    for name, folders in PERSONAL.items():
        private = F.when(kind == name, F.concat(*[_part(f) for f in folders])).otherwise(private)
    personal = F.concat(_part(p.personal_root), F.coalesce(private, _part("Administrative")), year)
    photo = (kind == "photo") & F.lit(p.photos_in_projects) & project.isNotNull()
    by_project = project.isNotNull() & ((F.col("rule") == "project") | photo | (within & (F.lit(not p.client_first) | customer.isNull())))
    in_project = F.concat(_part("Projects"), _part(project), _part(folder, True), year)
    client = (
        F.when(customer.isNotNull(), F.concat(_part("Clients"), _part(customer), _part(project))).when(project.isNotNull(), F.concat(_part("Projects"), _part(project)))
        .when(supplier.isNotNull(), F.concat(_part("Suppliers"), _part(supplier))).otherwise(_part(area))
    )
    by_client = F.concat(client, year, _part(folder, True))
    by_type = F.concat(_part(F.coalesce(folder, area)), _part(F.coalesce(customer, supplier)), _part(project), year)
    business = F.concat(_part(p.business_root), F.when(F.coalesce(by_project, F.lit(False)), in_project).otherwise(by_client if p.client_first else by_type))
    return F.when(F.col("context") == "personal", personal).when(F.col("context") == "business", business).otherwise(_part(TO_REVIEW))


def machine_name(p: Preferences) -> Column:
    """A telling name for confident files whose own says nothing: date, party, type and identifier, if two of them are known; else the file's own, made safe."""
    kind, party = F.col("document_type"), F.coalesce("supplier", "customer")
    label = F.when(kind != "unknown", F.coalesce(_named(kind, SINGULAR), F.lit("Document")))
    known = F.array_compact(F.array(F.col("date"), party, label, F.col("identifier")))
    parts = F.filter(F.transform(F.split(F.array_join(known, "_"), "_"), lambda x: F.btrim(x)), lambda x: x != "")
    ending = F.regexp_extract("name", r"^.+([.][^.]+)$", 1)
    telling = (F.col("confidence") >= HIGH) & generic_name(F.col("name")) & (F.size(known) >= 2)
    return F.when(telling, F.concat(F.array_join(parts, "_"), ending)).otherwise(F.col("name"))


def equal_paths(a: Column, b: Column) -> Column:
    return F.lower(F.array_join(a, "\\")) == F.lower(F.array_join(b, "\\"))


def disruption(source: Column, destination: Column, name: Column, new_name: Column) -> Column:
    """How much a move disturbs: the share of folders that change by .85, and .15 for a new name."""
    a, b = (F.array_distinct(F.transform(c, lambda x: F.lower(x))) for c in (source, destination))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    renamed = F.when(F.lower(name) == F.lower(new_name), 0.0).otherwise(0.15)
    return F.when(equal_paths(source, destination) & (F.lower(name) == F.lower(new_name)), 0.0).otherwise((1 - shared) * 0.85 + renamed)


def compiled(files: DataFrame, p: Preferences = Preferences()) -> DataFrame:  # noqa: B008
    """One draft for every row of ``files``; no file depends on another here.

    ``files`` have ``file_id, path, name, context, context_confidence, document_type, type_confidence, customer, supplier, project,
    relation_confidence, date, identifier, quality, semantic_status, extraction_status, review_reasons, duplicate``; what their rules say: ``rule``
    (``project``, ``destination`` or ``preserve``), ``rule_destination``, ``rule_years``; and what users decided: ``override`` (``destination``, ``rename``,
    ``both``, ``keep``, ``reject`` or ``review``), ``override_destination``, ``override_name``. Null means unknown. ``date`` and ``identifier`` are
    null unless they are sure. Confidences of confirmed signals are 1.

    A draft is reviewed for an unclear context or type, poor or partial input, open reviews, or little confidence; reviewed files of little
    confidence or unclear context go to ``TO_REVIEW``. A rule's destination or the present folders come before the policy, a user's decision before
    both. Paths are made to fit; those that do not are conflicts.
    """
    word = lambda c: F.coalesce(F.nullif(F.lower(F.btrim(c)), F.lit("")), F.lit("unknown"))
    rows = files.withColumns({"context": word("context"), "document_type": word("document_type"), "source": parent_parts(F.col("path"), F.col("name"))})
    signals = {
        "context": (F.col("context_confidence"), 0.35), "type": (F.col("type_confidence"), 0.3), "relation": (F.col("relation_confidence"), 0.25),
        "quality": (F.least(F.greatest("quality", F.lit(0.0)), F.lit(1.0)), 0.1),
    }
    has_reviews = F.coalesce(F.col("review_reasons") != "", F.lit(False))
    sure = weighted_confidence(signals, F.coalesce(F.col("semantic_status") == "partial", F.lit(False)), has_reviews)
    rows = rows.withColumn("confidence", F.round(F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)), 9))
    unclear = F.col("context").isin("unknown", "mixed")
    asked = [
        (unclear, "ambiguous_context"),
        ((F.col("document_type") == "unknown") | F.coalesce(F.col("type_confidence") < HIGH, F.lit(True)), "uncertain_document_type"),
        (~F.coalesce(F.col("semantic_status").isin("success", "partial"), F.lit(False)) | F.coalesce(F.col("quality") < 0.65, F.lit(True)), "semantic_input_quality"),
        (F.coalesce(F.col("extraction_status") != "success", F.lit(False)), "partial_extraction"), (has_reviews, "existing_review_state"),
        (F.col("confidence") < p.review_below, "user_preference"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, r in asked]))
    doubtful = reduce(lambda a, b: a | b, [c for c, _ in asked]) | (F.col("confidence") < LOW)
    rows = rows.withColumns({"reasons": reasons, "needs_review": doubtful})
    aside = F.col("needs_review") & ((F.col("confidence") < LOW) | unclear)
    rows = rows.withColumn("_target", F.when(aside, _part(TO_REVIEW)).otherwise(policy(p)))
    given = F.transform("rule_destination", lambda s: F.struct(s.alias("name"), F.lit(False).alias("optional")))
    safe = pathfit.valid_destination(F.col("rule_destination"), p.depth)
    here = F.transform("source", lambda s: F.struct(s.alias("name"), F.lit(False).alias("optional")))
    # few files lie in such folders; only theirs are compared with the target
    rooted = F.lit(p.preserve_folders) & ~F.col("needs_review") & F.size("source").between(1, p.depth) & F.lower(F.get("source", F.lit(0))).isin(*SEMANTIC_ROOTS)
    rows = rows.withColumn("_held", F.when(rooted, F.array_distinct(F.transform("_target", lambda t: F.lower(t["name"])))))
    rows = rows.withColumn("_matching", F.when(F.col("_held").isNotNull(), F.size(F.filter("source", lambda s: F.array_contains("_held", F.lower(s))))))
    useful = (F.col("_matching") >= 2) & (F.col("_matching") * 2 >= F.least(F.size("source"), F.size("_held"))) & ~F.exists("source", lambda s: component_fault(s, pathfit.SEGMENT).isNotNull())
    ruled = F.col("rule") == "destination"
    rows = rows.withColumns({
        "_target": F.when(ruled & safe, given).when(ruled, _part(TO_REVIEW)).when(F.col("rule") == "preserve", here).when(F.coalesce(useful, F.lit(False)), here).otherwise(F.col("_target")),
        "needs_review": F.col("needs_review") | F.coalesce(ruled & ~safe, F.lit(False)),
        "reasons": F.concat("reasons", F.array_compact(F.array(F.when(ruled & ~safe, "invalid_user_rule")))),
    })
    rows = pathfit.fitted(rows.withColumns({"_folders": F.col("_target.name"), "_name": machine_name(p)}), "_folders", "_name", p.depth)
    rows = rows.withColumns({
        "machine_destination": F.col("fit.folders"), "machine_name": F.col("fit.name"), "needs_review": F.col("needs_review") | ~F.col("fit.valid"),
        "optional": F.slice(F.col("_target.optional"), 1, p.depth), "conflict": F.when(~F.col("fit.valid"), "path_too_long").otherwise("none"),
    })
    o = F.col("override")
    mine = o.isNotNull()
    goes = F.when(o.isin("destination", "both") & F.col("override_destination").isNotNull(), F.col("override_destination")).when(o.isin("keep", "reject"), F.col("source"))
    goes = goes.when(o == "review", F.array(F.lit(TO_REVIEW))).otherwise(F.col("machine_destination"))
    called = F.when(o.isin("rename", "both") & F.col("override_name").isNotNull(), F.col("override_name")).when(o.isin("keep", "reject"), F.col("name")).otherwise(F.col("machine_name"))
    rows = rows.withColumns({"destination": goes, "new_name": called})
    wrong = ~pathfit.valid_destination(F.col("destination"), p.depth) | component_fault(F.col("new_name"), pathfit.FILENAME).isNotNull()
    long = pathfit.path_length(F.col("destination"), F.col("new_name")) > pathfit.PATH
    rows = rows.withColumn("_fault", F.when(mine, F.when(wrong, "invalid_path").when(long, "path_too_long")))
    rows = rows.withColumns({
        "conflict": F.coalesce("_fault", "conflict"),
        "needs_review": F.when(F.col("_fault").isNotNull(), True).when(o.isin("keep", "reject"), False).when(o == "review", True).otherwise(F.col("needs_review")),
        "optional": F.when(mine, F.transform("destination", lambda _: F.lit(False))).otherwise(F.col("optional")),
        "reasons": F.concat("reasons", F.array_compact(F.array(F.when(mine, "user_override")))),
    })
    same_place, same_name = equal_paths(F.col("source"), F.col("destination")), F.lower("name") == F.lower("new_name")
    kind = (
        F.when(F.coalesce("duplicate", F.lit(False)), "no_action").when(o.isin("keep", "reject"), "keep_in_place").when(F.array_join("destination", "\\") == TO_REVIEW, "to_review")
        .when(same_place & same_name, "keep_in_place").when(same_place, "rename").otherwise("move")
    )
    return rows.select(
        "file_id", "source", "name", "machine_destination", "machine_name", "destination", "optional", "new_name", kind.alias("kind"), "confidence",
        confidence_band(F.col("confidence")).alias("level"), "needs_review", "conflict", "reasons", mine.alias("overridden"), "customer", "supplier", "project",
        F.coalesce("duplicate", F.lit(False)).alias("duplicate"),
    )


def _prefixes(folders: Column) -> Column:
    """Every folder on the way to a destination, lower-cased and joined; none of an empty one."""
    low = F.transform(folders, lambda x: F.lower(x))
    return F.when(F.size(folders) > 0, F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(low, 1, n), "\\"))).otherwise(F.array().cast("array<string>"))


def group_sizes(drafts: DataFrame) -> DataFrame:
    """``(folder, files)``: how many drafts are meant for each folder or one below it."""
    return drafts.select(F.explode(_prefixes(F.col("destination"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def grouped(drafts: DataFrame, least: int, sizes: DataFrame | None = None) -> DataFrame:
    """Drafts without optional folders at the end of their destination that would hold fewer than ``least`` files.

    A file leaves a folder only when the folder itself is too small, and files below stay counted, so what a folder holds is its number of drafts
    at the start: one count of folders decides all levels at once, without rounds. ``sizes`` are ``group_sizes`` of all drafts, if known.
    """
    if least <= 1:
        return drafts
    few = (group_sizes(drafts) if sizes is None else sizes).where(F.col("files") < least).select("folder")
    tails = drafts.where(F.exists("optional", lambda o: o)).select("file_id", F.posexplode(F.arrays_zip(_prefixes(F.col("destination")).alias("folder"), F.col("optional").alias("optional"))).alias("at", "p"))
    # the last level that stays: not optional, or large enough
    stays = tails.select("file_id", "at", F.col("p.folder").alias("folder"), F.col("p.optional").alias("optional")).join(few.withColumn("_few", F.lit(True)), "folder", "left")
    keep = stays.groupBy("file_id").agg(F.coalesce(F.max(F.when(~(F.col("optional") & F.col("_few").isNotNull()), F.col("at") + 1)), F.lit(0)).alias("_keep"))
    rows = drafts.join(hashed(keep), "file_id", "left")
    n = F.coalesce("_keep", F.size("destination"))
    cut = n < F.size("destination")
    less = F.size("destination") - n
    return rows.withColumns({
        "machine_destination": F.when(cut, F.slice("machine_destination", 1, F.greatest(F.size("machine_destination") - less, F.lit(0)))).otherwise(F.col("machine_destination")),
        "reasons": F.concat("reasons", F.when(cut, F.array(F.lit("minimum_group_policy"))).otherwise(F.array().cast("array<string>"))),
        "destination": F.slice("destination", 1, n), "optional": F.slice("optional", 1, n),
    }).drop("_keep")


NUMBERED = r"^(.+)_([1-9][0-9]{0,8})((?:[.][^.]{1,16})?)$"


class _Family:
    """Numbers for the files of one family, whose names differ in their stems only, as they come in order of their ids: each takes the next that nobody before it has.

    Holds the stems that came and, for each, the runs of numbers given out. Names made from different stems are never equal, so a made name matters only to
    a file whose own it is, and that file finds it among the runs.
    """

    def __init__(self) -> None:
        self.count: dict[str, int] = {}
        self.runs: dict[str, list[list[int]]] = {}

    def _given(self, stem: str) -> bool:
        base, _, n = stem.rpartition("_")
        if not n.isdecimal() or not n.isascii() or n[0] == "0" or base not in self.runs:
            return False
        runs, n = self.runs[base], int(n)
        at = bisect_right(runs, n, key=lambda r: r[0]) - 1
        return at >= 0 and n <= runs[at][1]

    def add(self, stem: str, overridden: bool) -> tuple[int, int]:
        """``(ordinal, number)`` of the next file; 0 for one that keeps its name."""
        known = self.count.get(stem)
        self.count[stem] = ordinal = (int(self._given(stem)) if known is None else known) + 1
        if ordinal == 1 or overridden:
            return ordinal, 0
        runs = self.runs.setdefault(stem, [])
        # all numbers from an earlier ordinal to what it got are taken
        number = max(ordinal, runs[-1][1] + 1 if runs else 1)
        while f"{stem}_{number}" in self.count:
            number += 1
        if runs and runs[-1][1] == number - 1:
            runs[-1][1] = number
        else:
            runs.append([number, number])
        return ordinal, number


def _one_by_one(rows: pd.DataFrame) -> pd.DataFrame:
    """``_Family`` over the files of one family that are all at hand."""
    family = _Family()
    out = [(r.file_id, *family.add(r.stem, r.overridden)) for r in rows.sort_values("file_id").itertuples(index=False)]
    return pd.DataFrame(out, columns=["file_id", "ordinal", "number"])


def _family_by_family(batches):
    """``_Family`` over rows ``(family, ending, file_id, stem, overridden)`` in order; families come one after the other, and rows as they are read."""
    of, family = None, _Family()
    for batch in batches:
        out = []
        for name, ending, stem, mine in zip(*(batch.column(c).to_pylist() for c in ("family", "ending", "stem", "overridden")), strict=True):
            if (name, ending) != of:
                of, family = (name, ending), _Family()
            out.append(family.add(stem, mine))
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), *(pa.array([o[i] for o in out], pa.int64()) for i in (0, 1))], names=["file_id", "ordinal", "number"])


def settled(drafts: DataFrame) -> DataFrame:
    """Drafts with different paths: of those that want one name in one folder, whatever its case, the first by id keeps it, others get ``_2``, ``_3`` and so on.

    A user's own name is not changed but marked. Files that stay take no part. Ordinals come from running totals, so one name that most
    files want is many tasks. Where a numbered name that a colliding file might get is another file's own, the files of that folder and stem are
    numbered one after the other; one task reads them in order and holds their distinct stems.
    """
    moving = ~F.col("kind").isin("keep_in_place", "no_action")
    key = collision_key(F.col("destination"), F.col("new_name"))
    stem, ending = F.regexp_extract("_key", r"^(.+?)([.][^.\\]{1,16})?$", 1), F.regexp_extract("_key", r"^(.+?)([.][^.\\]{1,16})?$", 2)
    slim = drafts.where(moving).select("file_id", key.alias("_key"), "overridden")
    slim = store(slim.select("file_id", "overridden", F.col("_key").alias("key"), stem.alias("stem"), ending.alias("ending")), "wanted-names")
    sizes = store(slim.groupBy("key", "stem", "ending").agg(F.count("*").alias("n")), "name-sizes")
    clashing = sizes.where("n > 1")
    # names like another's stem with a number: whoever collides there may meet them
    numbered = sizes.select(F.concat(F.regexp_extract("key", NUMBERED, 1), F.regexp_extract("key", NUMBERED, 3)).alias("key"), F.col("key").alias("other")).where("key <> ''")
    met = store(numbered.join(clashing.select("key"), "key"), "numbered-names")
    if met.isEmpty():
        slow = None
    else:
        family = F.regexp_replace("stem", r"(_[0-9]+)+$", "")
        of = lambda df: df.select(family.alias("family"), "ending")
        families = of(sizes.join(met.select("key"), "key", "left_semi")).distinct()
        parties = met.select("key").unionByName(met.select(F.col("other").alias("key"))).distinct()
        own = sizes.withColumn("family", family).join(families, ["family", "ending"], "left_semi").where("n > 1").select("key").unionByName(parties).distinct()
        slow = store(own, "numbered-keys")
    clash = split_join(slim, clashing.select("key", "n"), ["key"], "n")
    easy = clash if slow is None else clash.join(slow, "key", "left_anti")
    bucket = F.expr("file_id div 65536")
    fast = running_total(easy, ["key"], bucket, ["file_id"], F.lit(1).cast("long"), "ordinal")
    fast = fast.select("file_id", (F.col("ordinal") + 1).alias("ordinal"), F.when((F.col("ordinal") > 0) & ~F.col("overridden"), F.col("ordinal") + 1).otherwise(0).alias("number"))
    if slow is not None:
        one = slim.join(slow, "key", "left_semi").select(F.regexp_replace("stem", r"(_[0-9]+)+$", "").alias("family"), "ending", F.col("file_id").cast("long"), "stem", "overridden")
        one = one.repartition(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), "family", "ending").sortWithinPartitions("family", "ending", "file_id")
        fast = fast.unionByName(one.mapInArrow(_family_by_family, "file_id long, ordinal long, number long"))
    rows = drafts.join(hashed(fast), "file_id", "left")
    again = F.coalesce(F.col("ordinal") > 1, F.lit(False))
    # names are made for those that need one only
    rows = rows.withColumn("_numbered", F.when(again & ~F.col("overridden"), pathfit.numbered_name(F.col("new_name"), F.col("number"))))
    rows = rows.withColumn("_long", F.when(again, pathfit.path_length(F.col("destination"), F.col("_numbered")) > pathfit.PATH))
    named, long = F.col("_numbered"), F.col("_long")
    solved, stuck = again & ~F.col("overridden") & ~long, again & (F.col("overridden") | long)
    code = F.when(again & F.col("overridden"), "destination_collision").when(again & long, "unresolved_collision").when(again, "collision_resolved")
    return rows.withColumns({
        "conflict": F.when(solved, "auto_resolved").when(stuck, "destination_collision").otherwise(F.col("conflict")),
        "needs_review": F.col("needs_review") | stuck, "kind": F.when(stuck, "to_review").otherwise(F.col("kind")),
        "reasons": F.concat("reasons", F.array_compact(F.array(code))), "new_name": F.when(solved, named).otherwise(F.col("new_name")),
    }).drop("ordinal", "number", "_numbered", "_long")


def build(files: DataFrame, p: Preferences = Preferences()) -> DataFrame:  # noqa: B008
    """The whole proposal: drafts, small groups, collisions. Ids are integers and unique."""
    return settled(grouped(store_by(compiled(files, p), "drafts", "file_id"), p.least_group))


def dependencies(drafts: DataFrame) -> DataFrame:
    """``(kind, key, file_id)``: what other files' operations may depend on a file through, before groups and collisions are settled.

    Parties and projects, every folder on the way, and the names that numbering tells apart.
    """
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    single = F.array(*[entry(k, F.lower(k)) for k in ("customer", "supplier", "project")])
    folders = F.transform(_prefixes(F.col("destination")), lambda f: entry("folder", f))
    return drafts.select("file_id", F.inline(F.concat(single, folders))).where("key is not null").select("kind", "key", "file_id")


def incremental(drafts_before: DataFrame, proposal: DataFrame, changed: DataFrame, deleted: DataFrame, p: Preferences = Preferences()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """``(drafts, proposal, affected)`` after some files changed; equal to a whole build over all files.

    ``drafts_before`` and ``proposal`` are the compiled drafts and the operations of the last revision, both stored, ``changed`` files as ``compiled`` takes
    them, ``deleted`` ids. Only changed files are compiled. Then the effect is followed by keys: folders whose size crosses ``least_group``
    bring in the drafts that they are optional for; names in folders that any of these files leave or enter bring in all files that want
    a name of that stem. Everything else is carried over as it is. ``affected`` are the ids whose operations were computed again.

    Drafts and operations are dealt into buckets of their ids once; all later joins with them move ids and names only.
    """
    drafts_before, proposal = store_by(drafts_before, "drafts-before", "file_id"), store_by(proposal, "operations-before", "file_id")
    fresh = store(compiled(changed, p), "changed-drafts")
    gone = fresh.select("file_id").unionByName(deleted.select("file_id")).distinct()
    out = store(drafts_before.join(hashed(gone), "file_id", "left_semi"), "left-drafts")
    gone = store(gone, "changed-ids")
    left = drafts_before.join(hashed(gone), "file_id", "left_anti")
    drafts = left.unionByName(fresh.select(*drafts_before.columns))
    # folders whose size is now on the other side of the limit
    moved = group_sizes(fresh).select("folder", F.col("files").alias("d")).unionByName(group_sizes(out).select("folder", (-F.col("files")).alias("d")))
    moved = store(moved.groupBy("folder").agg(F.sum("d").alias("d")), "size-changes")
    near = drafts.select("file_id", "optional", F.explode(F.arrays_zip(_prefixes(F.col("destination")).alias("folder"), F.col("optional").alias("o"))).alias("x"))
    near = near.select("file_id", F.col("x.folder").alias("folder"), F.col("x.o").alias("o")).join(small(moved), "folder")
    sizes = store(near.groupBy("folder").agg(F.count("*").alias("files"), F.first("d").alias("d")), "sizes-near")
    crossed = sizes.where((F.col("files") < p.least_group) != (F.col("files") - F.col("d") < p.least_group)).select("folder")
    regrouped = near.where("o").join(small(crossed), "folder", "left_semi").select("file_id").unionByName(fresh.select("file_id")).distinct()
    regrouped = store(regrouped, "regrouped")
    again = left.join(hashed(regrouped), "file_id", "left_semi").unionByName(fresh.select(*drafts_before.columns))
    # their folders' sizes over all drafts
    asked = store(again.select(F.explode(_prefixes(F.col("destination"))).alias("folder")).distinct(), "folders-asked")
    counts = drafts.select(F.explode(_prefixes(F.col("destination"))).alias("folder")).join(asked, "folder", "left_semi").groupBy("folder").agg(F.count("*").alias("files"))
    again = store(grouped(again, p.least_group, counts), "regrouped-drafts")

    def names(rows: DataFrame, name: str) -> DataFrame:
        k = collision_key(F.col("destination"), F.col(name))
        return rows.select("file_id", F.regexp_replace(F.regexp_replace(k, r"([.][^.\\]{1,16})$", ""), r"(_[0-9]+)+$", "").alias("stem"))

    # what stands in the last proposal, with the name it wanted then
    wanted = F.when(F.array_contains("reasons", "collision_resolved"), F.col("machine_name")).otherwise(F.col("new_name"))
    stands = proposal.withColumn("_wanted", wanted)
    touched = names(again, "new_name").unionByName(names(stands.join(hashed(regrouped.unionByName(gone)), "file_id", "left_semi"), "_wanted"))
    stems = touched.select("stem").distinct()
    rest = stands.join(hashed(gone.unionByName(regrouped)), "file_id", "left_anti")
    beside = names(rest, "_wanted").join(stems, "stem", "left_semi").select("file_id")
    # those beside keep their groups; their names are settled again from what they wanted
    reset = grouped_before(left, rest.join(hashed(beside), "file_id", "left_semi"))
    renewed = store(settled(store_by(again.unionByName(reset.select(*again.columns)), "to-settle", "file_id")), "renewed")
    kept = rest.join(hashed(renewed.select("file_id")), "file_id", "left_anti").drop("_wanted")
    return drafts, kept.select(*proposal.columns).unionByName(renewed.select(*proposal.columns)), renewed.select("file_id")


def rebuild_reason(proposal: DataFrame, changed: DataFrame, deleted: DataFrame, rules_changed: bool = False, most: int = DIRTY_LIMIT) -> str | None:
    """Why the next revision is built whole; null if it is built from what changed. Counts at most one row beyond the limit."""
    if rules_changed:
        return "preferences_or_rules_changed"
    if proposal.isEmpty():
        return "no_previous_proposal"
    dirty = changed.select("file_id").unionByName(deleted.select("file_id")).distinct().limit(most + 1).count()
    return "empty_dirty_set" if not dirty else f"dirty_set_too_large:>{most}" if dirty > most else None


def grouped_before(drafts: DataFrame, operations: DataFrame) -> DataFrame:
    """Drafts as they were before collisions: the compiled draft with the folders that the operation kept."""
    size = operations.select("file_id", F.size("destination").alias("_n"), F.array_contains("reasons", "minimum_group_policy").alias("_cut"))
    rows = drafts.join(hashed(size), "file_id")
    less = F.size("destination") - F.col("_n")
    return rows.withColumns({
        "machine_destination": F.when(F.col("_cut"), F.slice("machine_destination", 1, F.greatest(F.size("machine_destination") - less, F.lit(0)))).otherwise(F.col("machine_destination")),
        "reasons": F.concat("reasons", F.when(F.col("_cut"), F.array(F.lit("minimum_group_policy"))).otherwise(F.array().cast("array<string>"))),
        "destination": F.slice("destination", 1, F.col("_n")), "optional": F.slice("optional", 1, F.col("_n")),
    }).drop("_n", "_cut")


def summary(proposal: DataFrame) -> DataFrame:
    """One row of figures about a proposal."""
    kind, depth = F.col("kind"), F.size("destination")
    return proposal.agg(
        F.count("*").alias("files"), F.count_if(kind == "move").alias("moves"), F.count_if(F.lower("name") != F.lower("new_name")).alias("renames"),
        F.count_if(kind.isin("keep_in_place", "no_action")).alias("unchanged"), F.count_if(kind == "to_review").alias("unresolved"), F.count_if("needs_review").alias("needs_review"),
        F.count_if(F.col("conflict") != "none").alias("conflicts"), F.count_if("duplicate").alias("duplicates"), F.count_if(F.col("level").isin("very_high", "high")).alias("high"),
        F.count_if(F.col("level") == "medium").alias("medium"), F.count_if(F.col("level") == "low").alias("low"),
        F.coalesce(F.max(depth), F.lit(0)).cast("long").alias("greatest_depth"), F.round(F.coalesce(F.avg(depth), F.lit(0.0)), 6).alias("mean_depth"),
    )


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files added and deleted, destinations changed, conflicts resolved, files that now need review."""
    side = lambda df, s: df.select("file_id", F.lower(F.array_join(F.array_append("destination", F.col("new_name")), "\\")).alias(f"_at{s}"), F.col("conflict").alias(f"_c{s}"), F.col("needs_review").alias(f"_r{s}"))
    rows = side(before, 1).join(side(after, 2), "file_id", "full")
    both = F.col("_at1").isNotNull() & F.col("_at2").isNotNull()
    return rows.agg(
        F.count_if(F.col("_at1").isNull()).alias("added"), F.count_if(F.col("_at2").isNull()).alias("deleted"), F.count_if(both & (F.col("_at1") != F.col("_at2"))).alias("changed"),
        F.count_if(both & (F.col("_c1") != "none") & (F.col("_c2") == "none")).alias("resolved"), F.count_if(both & ~F.col("_r1") & F.col("_r2")).alias("to_review"),
    )


def tree(proposal: DataFrame) -> DataFrame:
    """``(node, depth, files, children, reviews, conflicts)`` of every folder of the proposal, the root as an empty name."""
    levels = F.transform(F.sequence(F.lit(0), F.size("destination")), lambda n: F.struct(F.array_join(F.slice("destination", 1, n), "\\").alias("node"), n.cast("long").alias("depth")))
    rows = proposal.select(F.inline(levels), "needs_review", (F.col("conflict") != "none").alias("_c"), (F.size("destination") == F.lit(0)).alias("_bare"))
    nodes = rows.groupBy("node", "depth").agg(F.count("*").alias("files"), F.count_if("needs_review").alias("reviews"), F.count_if("_c").alias("conflicts"))
    above = F.when(F.col("depth") > 1, F.regexp_replace("node", r"\\[^\\]*$", "")).otherwise("")
    below = nodes.where("depth > 0").groupBy(above.alias("node")).agg(F.count("*").alias("folders"))
    own = proposal.groupBy(F.array_join("destination", "\\").alias("node")).agg(F.count_distinct("new_name").alias("names"))
    out = nodes.join(below, "node", "left").join(own, "node", "left")
    return out.select("node", "depth", "files", (F.coalesce("folders", F.lit(0)) + F.coalesce("names", F.lit(0))).alias("children"), "reviews", "conflicts")
