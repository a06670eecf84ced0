"""Facts in text: addresses, dates, money, document types, and the resolution of competing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.plans.sizes import small

EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
ISO_DATE = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"
MONEY = r"([0-9]+(?:[.,][0-9]{2})?) ?(EUR|USD|GBP)\b"
# Phrases that point at a document type, with their weights.
TYPE_PHRASES = [
    ("invoice", "facture", 0.62), ("invoice", "facture no", 0.24), ("invoice", "total ttc", 0.22), ("quote", "devis", 0.7),
    ("quote", "devis no", 0.2), ("letter", "madame, monsieur", 0.42), ("letter", "objet", 0.3),
]


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def emails(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, email)``, lower-cased, each once a text; addresses over 254 characters or with two dots in a row are left out."""
    rows = docs.select(id_col, F.explode(F.array_distinct(all_matches(F.lower(text_col), EMAIL))).alias("email"))
    return rows.where((F.length("email") <= 254) & ~F.contains("email", F.lit("..")))


def money(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, position, amount_minor, currency)``: decimals only where exactly two digits follow the mark."""
    zipped = F.arrays_zip(all_matches(F.col(text_col), MONEY, 1).alias("v"), all_matches(F.col(text_col), MONEY, 2).alias("c"))
    rows = docs.select(id_col, F.posexplode(zipped).alias("position", "m")).select(id_col, F.col("position").cast("long"), "m.v", "m.c")
    digits = F.regexp_replace("v", "[.,]", "").cast("long")
    minor = F.when(F.col("v").rlike("[.,]"), digits).otherwise(digits * 100)
    return rows.select(id_col, "position", minor.alias("amount_minor"), F.col("c").alias("currency"))


def iso_dates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, iso_date)``: calendar dates only, each once a text."""
    rows = docs.select(id_col, F.explode(F.array_distinct(all_matches(F.col(text_col), ISO_DATE, 1))).alias("iso_date"))
    return rows.where(F.col("iso_date").try_cast("date").isNotNull())


def document_types(docs: DataFrame, id_col: str, text_col: str, phrases: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """``(id_col, document_type, score)``: the type whose phrases in the text weigh most, ``unknown`` without any."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    weights: dict[str, Column] = {}
    for kind, phrase, weight in TYPE_PHRASES if phrases is None else phrases:
        part = F.when(F.contains(low, F.lit(phrase)), F.lit(weight)).otherwise(F.lit(0.0))
        weights[kind] = weights[kind] + part if kind in weights else part
    options = F.array(*[F.struct((-F.least(w, F.lit(0.99))).alias("s"), F.lit(k).alias("k")) for k, w in sorted(weights.items())])
    rows = docs.select(id_col, F.array_min(options).alias("best"))
    found = F.col("best.s") < 0
    return rows.select(id_col, F.when(found, F.col("best.k")).otherwise("unknown").alias("document_type"), F.when(found, -F.col("best.s")).otherwise(0.0).alias("score"))


def text_quality(text: Column, status: Column) -> Column:
    """0 to 1 from how extraction ended, how much text there is and how much of it is malformed."""
    base = F.when(status == "success", 1.0).when(status == "partial", 0.78).when(status.isin("unsupported", "skipped"), 0.35).when(status == "failed", 0.2).otherwise(0.3)
    body = F.coalesce(text, F.lit(""))
    bad = F.length(body) - F.length(F.translate(body, "�", ""))
    base = F.when(F.length(F.trim(body)) == 0, F.least(base, F.lit(0.25))).otherwise(base)
    return F.when(bad > 0.08 * F.length(body), base * 0.65).otherwise(base)


def resolve(candidates: DataFrame, key: list[str], value: str, confidence: str, close: float = 0.12, least: float = 0.65, sure: float = 0.85) -> DataFrame:
    """``key`` with ``value``, ``confidence``, ``status``: one answer from competing candidates, or none.

    Repeated values support each other: the strongest keeps its confidence plus .18 of each other, .99 at most. Two
    different values at ``least`` or more and closer than ``close`` conflict; below ``least`` nothing is known. Merged confidences
    are rounded to nine places before they are compared, so the order in which a sum is added up decides nothing.
    """
    merged = candidates.groupBy(*key, value).agg(F.max(confidence).alias("_top"), F.sum(confidence).alias("_all"))
    merged = merged.withColumn("_c", F.round(F.least(F.col("_top") + 0.18 * (F.col("_all") - F.col("_top")), F.lit(0.99)), 9))
    order = Window.partitionBy(*key).orderBy(F.desc("_c"), value)
    best = merged.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("_c").over(order)).where("_n = 1")
    clash = (F.col("_next") >= least) & (F.col("_c") - F.col("_next") < close)
    status = F.when(F.col("_c") < least, "unknown").when(clash, "conflicting").when(F.col("_c") >= sure, "confirmed").otherwise("inferred")
    out = best.withColumn("status", status)
    known = F.col("status").isin("confirmed", "inferred")
    return out.select(*key, F.when(known, F.col(value)).alias(value), F.col("_c").alias("confidence"), "status")


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, rows, mean_probability, share_positive, brier_sum)`` over equal bins of the probability."""
    p, y = F.col("probability"), F.col("positive").cast("int")
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long")
    return predictions.where(p.isNotNull() & y.isNotNull()).groupBy(at.alias("bin")).agg(
        F.count("*").alias("rows"), F.avg(p).alias("mean_probability"), F.avg(y).alias("share_positive"), F.sum((p - y) * (p - y)).alias("brier_sum"),
    )


def lookup(rows: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of a rule table, which is broadcast only while it is small."""
    return rows.join(small(rules), on, "left")


# Words that point at a language or a context.
LANGUAGE_CUES = {"fr": (" le ", " la ", " de ", " facture", " montant", " client"), "en": (" the ", " of ", " invoice", " amount", " customer", " due ")}
BUSINESS_CUES = ("siret", "tva", "vat number", "fournisseur", "supplier", "client:", "customer:", "purchase order", "bon de commande")
PERSONAL_CUES = ("numéro fiscal", "taxpayer", "date de naissance", "date of birth", "domicile", "adresse personnelle")
MIXED_TYPES, PERSONAL_TYPES = ("payslip", "employment_contract"), ("tax_document", "cv")
BUSINESS_TYPES = ("invoice", "quote", "contract", "purchase_order", "delivery_note", "bank_statement")


def cues(text: Column, words: tuple[str, ...]) -> Column:
    """How many of ``words`` a text holds, in any letter case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = [F.contains(low, F.lit(w)).cast("int") for w in words]
    return sum(parts[1:], parts[0])


def language(text: Column, hint: Column | None = None) -> Column:
    """``fr`` or ``en`` by the hint's first letters, else by at least two cues and more than the other has; null if neither."""
    fr, en = (cues(text, LANGUAGE_CUES[k]) for k in ("fr", "en"))
    by_cues = F.when((fr >= 2) & (fr > en), "fr").when((en >= 2) & (en > fr), "en")
    if hint is None:
        return by_cues
    low = F.lower(hint)
    return F.when(F.startswith(low, F.lit("fr")), "fr").when(F.startswith(low, F.lit("en")), "en").otherwise(by_cues)


def context(text: Column, document_type: Column) -> Column:
    """``mixed``, ``business``, ``personal`` or ``unknown`` from cues and the document's type."""
    work, home = cues(text, BUSINESS_CUES), cues(text, PERSONAL_CUES)
    kind = F.coalesce(document_type, F.lit(""))
    return (
        F.when(kind.isin(*MIXED_TYPES) | ((work > 0) & (home > 0)), "mixed").when(kind.isin(*BUSINESS_TYPES) | (work >= 2), "business")
        .when(kind.isin(*PERSONAL_TYPES) | (home >= 2), "personal").otherwise("unknown")
    )


def labelled(docs: DataFrame, id_col: str, text_col: str, labels: list[str]) -> DataFrame:
    """``(id_col, line, label, value)`` of lines ``label [:#-] value``, the first label in the order given that a line begins with and that has a value."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n")).alias("line", "_line"))

    def value(label: str) -> Column:
        return F.trim(F.regexp_extract("_line", rf"(?i)^\s*\Q{label}\E\s*[:#\-–]\s*(\S.*)$", 1))

    tried = F.array(*[F.struct(F.lit(x).alias("label"), value(x).alias("value")) for x in labels])
    rows = lines.withColumn("_hit", F.get(F.filter(tried, lambda t: t["value"] != ""), 0)).where("_hit is not null")
    return rows.select(id_col, F.col("line").cast("long").alias("line"), "_hit.label", "_hit.value")


def phone(value: Column) -> Column:
    """Digits of a phone number, with a leading plus if it has one; null unless it has 8 to 15 digits and no odd characters."""
    text = F.trim(value)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(text.rlike(r"^[+]?[0-9 .()-]+$") & F.length(digits).between(8, 15), F.concat(F.when(F.startswith(text, F.lit("+")), "+").otherwise(""), digits))


def company_id(value: Column) -> Column:
    """Letters and digits of a company identifier, upper-cased; null unless 8 to 32, not all the same, and Luhn-valid where 9 or 14 digits."""
    text = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    numbered = text.rlike("^([0-9]{9}|[0-9]{14})$")
    good = F.length(text).between(8, 32) & ~text.rlike("^(.)\\1*$") & (~numbered | F.call_function("luhn_check", text))
    return F.when(good, text)


def review_reasons(fields: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, reasons)``, comma-joined, of documents that need review, from rows ``(field, value, confidence, status)``."""
    is_type, has = F.col("field") == "document_type", F.col("value").isNotNull()
    kind = F.max(F.when(is_type, F.col("value"))).alias("kind")
    any_of = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    held = lambda name: any_of((F.col("field") == name) & has, name)
    critical = {"invoice": ("invoice_number", "total"), "quote": ("quote_number", "amount"), "contract": ("contract_parties", "issue_date")}
    rows = fields.groupBy(id_col).agg(
        kind, any_of(F.col("status") == "conflicting", "clash"), any_of(F.col("status") == "ambiguous", "vague"),
        any_of(is_type & ~has & (F.col("confidence") >= 0.3), "unsure"), any_of(is_type & (F.col("confidence") >= 0.85), "sure"),
        *[held(n) for pair in critical.values() for n in pair],
    )
    missing = F.lit(False)
    for name, (a, b) in critical.items():
        missing = missing | ((F.col("kind") == name) & ~F.col(a) & ~F.col(b))
    reasons = F.concat_ws(
        ",", F.when(F.col("clash"), "conflicting_fields"), F.when(F.col("unsure"), "low_confidence_document_type"),
        F.when(F.col("vague"), "semantic_ambiguity"), F.when(F.col("sure") & missing, "missing_critical_fields"),
    )
    return rows.select(id_col, reasons.alias("reasons")).where("reasons <> ''")
