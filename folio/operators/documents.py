"""What a document is and says: its type by weighted indicators, quality, dates, money, and the fields of its type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# For each type the phrases, any of which counts once with the weight, and whether they count in the header only.
INDICATORS = {
    "invoice": [
        (("facture n", "facture no", "invoice number", "invoice no", "invoice #"), 0.48, False), (("facture", "invoice"), 0.28, True),
        (("montant ttc", "total ttc", "total due", "amount due"), 0.24, False), (("fournisseur", "supplier", "vendor"), 0.12, False),
    ],
    "quote": [
        (("devis n", "devis no", "quote number", "quotation no", "estimate no"), 0.5, False), (("devis", "quotation", "quote", "estimate"), 0.3, True),
        (("validité", "valid until", "expiration date"), 0.2, False),
    ],
    "contract": [
        (("contrat", "contract", "agreement"), 0.48, True), (("entre les soussignés", "between the parties", "party 1", "party 2"), 0.28, False),
        (("signature", "signed by", "fait à"), 0.2, False),
    ],
    "purchase_order": [(("bon de commande", "purchase order"), 0.65, True), (("po number", "commande n"), 0.3, False)],
    "delivery_note": [(("bon de livraison", "delivery note"), 0.7, True), (("livré le", "delivered on"), 0.22, False)],
    "bank_statement": [(("relevé de compte", "bank statement", "account statement"), 0.7, True), (("iban", "solde", "opening balance", "closing balance"), 0.22, False)],
    "tax_document": [(("avis d'impôt", "avis d’imposition", "tax notice", "income tax"), 0.7, True), (("revenu fiscal", "taxpayer", "numéro fiscal"), 0.22, False)],
    "payslip": [(("bulletin de paie", "bulletin de salaire", "payslip", "pay stub"), 0.72, True), (("salaire brut", "net à payer", "gross pay", "net pay"), 0.22, False)],
    "employment_contract": [(("contrat de travail", "employment contract"), 0.78, True), (("employeur", "employee", "salarié"), 0.18, False)],
    "insurance_document": [(("attestation d'assurance", "police d'assurance", "insurance policy"), 0.72, True), (("assuré", "policyholder", "numéro de police"), 0.2, False)],
    "receipt": [(("ticket de caisse", "receipt"), 0.62, True), (("merci de votre achat", "cash", "change due"), 0.2, False)],
    "cv": [(("curriculum vitae", "resume"), 0.7, True), (("expérience professionnelle", "work experience", "education"), 0.2, False)],
    "report": [(("rapport", "report"), 0.68, True)],
    "letter": [(("objet :", "subject:"), 0.35, True), (("madame, monsieur", "dear sir", "dear madam"), 0.35, False)],
}
HEADER_LINES, TOP_LINES = 12, 4
"""A header phrase counts at the start of one of the first twelve lines or anywhere in the first four."""
DATED_TYPES = ("invoice", "quote", "contract", "purchase_order", "delivery_note", "bank_statement", "tax_document", "payslip")
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMERIC_DATE = r"\b([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})\b"
ISO_DATE = r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b"
MONEY = r"(€|\$|£|EUR|USD|GBP)?[ \x{A0}]?\b([0-9]{1,3}(?:[ .,\x{A0}\x{202F}][0-9]{3})+(?:[.,][0-9]{2})?|[0-9]+(?:[.,][0-9]{1,2})?)\b[ \x{A0}]?(€|\$|£|EUR|USD|GBP)?"


def quality(status: Column, text: Column, truncated: Column, limited: Column, ocr: Column) -> Column:
    """0 to 1: how extraction ended, then factors for empty, truncated, limited, recognised (``ocr`` is its confidence, null for none) and malformed text.

    Malformed are U+FFFD and control characters other than tab and line ends, once they are over 8 % of the text.
    """
    base = F.when(status == "success", 1.0).when(status == "partial", 0.78).when(status.isin("unsupported", "skipped"), 0.35).when(status == "failed", 0.2).otherwise(0.3)
    body = F.coalesce(text, F.lit(""))
    bad = F.length(body) - F.length(F.regexp_replace(body, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))
    out = F.when(F.btrim(body) == "", F.least(base, F.lit(0.25))).otherwise(base)
    out = out * F.when(F.coalesce(truncated, F.lit(False)), 0.82).otherwise(1.0) * F.when(F.coalesce(limited, F.lit(False)), 0.86).otherwise(1.0)
    out = out * F.when(ocr.isNotNull(), 0.55 + 0.45 * ocr).otherwise(1.0)
    return out * F.when(bad > 0.08 * F.length(body), 0.65).otherwise(1.0)


def quality_band(q: Column, text: Column) -> Column:
    empty = F.btrim(F.coalesce(text, F.lit(""))) == ""
    return F.when(q >= 0.85, "good").when(q >= 0.6, "degraded").when(empty & (q <= 0.25), "unusable").otherwise("poor")


def type_scores(docs: DataFrame, id_col: str, text: Column, filename: Column, q: Column) -> DataFrame:
    """``(id_col, document_type, score)``: every type that indicators or the file's name point at.

    Indicators of a type add up, a filename that holds the type's first header word adds .2; at most .99, times half and half the quality.
    A type that only the name points at has at most .4. Lower-cased texts, header lines and quality are columns of their own, computed once a row.
    """
    low, name, quality_of, starts, top = (F.col(c) for c in ("low", "name", "q", "starts", "top"))
    read = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("low"), F.lower(F.coalesce(filename, F.lit(""))).alias("name"), q.alias("q"))
    read = read.withColumn("lines", F.slice(F.split(low, "\n"), 1, HEADER_LINES))
    read = read.select("id", "low", "name", "q", F.transform("lines", lambda x: F.ltrim(x)).alias("starts"), F.array_join(F.slice("lines", 1, TOP_LINES), "\n").alias("top"))

    def hit(phrases: tuple[str, ...], header: bool) -> Column:
        if not header:
            return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])
        begun = F.exists(starts, lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in phrases]))
        return begun | reduce(lambda a, b: a | b, [F.contains(top, F.lit(p)) for p in phrases])

    options = []
    for kind, indicators in INDICATORS.items():
        content = reduce(lambda a, b: a + b, [F.when(hit(ps, header), w).otherwise(0.0) for ps, w, header in indicators])
        named = F.when(F.contains(name, F.lit(kind.replace("_", " "))) | F.contains(name, F.lit(kind)), 0.2).otherwise(0.0)
        score = F.when(content > 0, F.least(content + named, F.lit(0.99)) * (0.5 + 0.5 * quality_of)).otherwise(F.least(named, F.lit(0.4)))
        options.append(F.struct(F.lit(kind).alias("document_type"), score.alias("score")))
    return read.select(F.col("id").alias(id_col), F.inline(F.filter(F.array(*options), lambda o: o["score"] > 0)))


def best_type(scores: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, document_type, score)``: the type of greatest score, ties by name."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "document_type")).alias("b")
    return scores.groupBy(id_col).agg(best).select(id_col, F.col("b.document_type").alias("document_type"), (-F.col("b.s")).alias("score"))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.expr("cast(null as date)") if year is None else F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")))


def numeric_dates(docs: DataFrame, id_col: str, text: Column, french: Column) -> DataFrame:
    """``(id_col, surface, iso_date, alternate, confidence)`` of ISO dates and of numeric ones that end in a year, each once a text.

    Which of two small numbers is the day is told by one over 12, else by the text's language, French putting the day first; then the other
    reading is the alternate. Dates that no calendar has are left out.
    """
    iso = F.transform(F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0)), lambda s: F.struct(s.alias("s"), F.lit(True).alias("iso"), F.lit(True).alias("fr")))
    other = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC_DATE), F.lit(0)), lambda s: F.struct(s.alias("s"), F.lit(False).alias("iso"), french.alias("fr")))
    rows = docs.select(id_col, F.explode(F.array_distinct(F.concat(iso, other))).alias("d")).select(id_col, "d.*")
    n = lambda k: F.regexp_extract("s", "([0-9]+)[^0-9]+([0-9]+)[^0-9]+([0-9]+)", k)
    first, second = n(1).cast("int"), n(2).cast("int")
    day_first, month_first = _day(n(3), n(2), n(1)), _day(n(3), n(1), n(2))
    plain = (first > 12) | (second > 12)
    chosen = F.when(F.col("iso"), _day(n(1), n(2), n(3))).when(first > 12, day_first).when(second > 12, month_first).when(F.col("fr"), day_first).otherwise(month_first)
    spare = F.when(~F.col("iso") & ~plain & (first != second), F.when(F.col("fr"), month_first).otherwise(day_first))
    sure = F.when(F.col("iso"), 0.99).when(first > 12, 0.98).when(second > 12, 0.95).otherwise(0.72)
    out = rows.select(id_col, F.col("s").alias("surface"), chosen.cast("string").alias("iso_date"), spare.cast("string").alias("alternate"), sure.alias("confidence"))
    return out.where("iso_date is not null")


def textual_dates(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id_col, surface, iso_date, confidence)`` of days written out in French or English (``12 mars 2019``, ``March 12, 2019``), each once a text."""
    months = {m: i + 1 for names in (FRENCH_MONTHS, ENGLISH_MONTHS) for i, m in enumerate(names)}
    named = "(" + "|".join(months) + ")"
    number = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    low = F.lower(F.coalesce(text, F.lit("")))
    first, second = rf"\b([0-9]{{1,2}})(?:er)? {named} ([0-9]{{4}})\b", rf"\b{named} ([0-9]{{1,2}}), ([0-9]{{4}})\b"
    found = F.concat(F.regexp_extract_all(low, F.lit(first), F.lit(0)), F.regexp_extract_all(low, F.lit(second), F.lit(0)))
    rows = docs.select(id_col, F.explode(F.array_distinct(found)).alias("surface"))
    part = lambda a, b: F.coalesce(F.nullif(F.regexp_extract("surface", first, a), F.lit("")), F.regexp_extract("surface", second, b))
    day = _day(part(3, 3), number[part(2, 1)], part(1, 2))
    return rows.select(id_col, "surface", day.cast("string").alias("iso_date"), F.lit(0.98).alias("confidence")).where("iso_date is not null")


def decimal_minor(number: Column) -> Column:
    """Hundredths of a printed number: a mark before exactly two last digits is the decimal one, all others group thousands."""
    flat = F.regexp_replace(number, r"[ \x{A0}\x{202F}]", "")
    cents = flat.rlike("[.,][0-9]{2}$")
    digits = F.regexp_replace(flat, "[.,]", "")
    return F.when(digits.rlike("^[0-9]{1,15}$"), F.when(cents, digits.cast("long")).otherwise(digits.cast("long") * 100))


def currency(mark: Column) -> Column:
    """``struct<code, confidence>`` of a currency's mark; without one the code is null and the confidence .68."""
    code = F.when(mark.isin("€", "EUR"), "EUR").when(mark.isin("$", "USD"), "USD").when(mark.isin("£", "GBP"), "GBP")
    return F.struct(code.alias("code"), F.when(mark == "$", 0.86).when(code.isNotNull(), 0.98).otherwise(0.68).alias("confidence"))


def rescaled(amount: Column, scale: Column) -> Column:
    """An amount of ``scale`` (0 to 4) decimals in hundredths, cut towards zero; null for other scales."""
    up, down = F.pow(F.lit(10), 2 - scale).cast("long"), F.pow(F.lit(10), scale - 2).cast("long")
    return F.when(scale.between(0, 2), amount * up).when(scale.between(3, 4), F.floor(amount / down).cast("long"))


def money_values(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id_col, position, amount_minor, currency, confidence)`` of numbers with a currency's mark before or behind them."""
    zipped = F.arrays_zip(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(g)).alias(n) for g, n in ((1, "before"), (2, "number"), (3, "behind"))])
    marked = F.filter(zipped, lambda m: (m["before"] != "") | (m["behind"] != ""))
    rows = docs.select(id_col, F.posexplode(marked).alias("position", "m"))
    mark = F.when(F.col("m.behind") != "", F.col("m.behind")).otherwise(F.col("m.before"))
    rows = rows.select(id_col, F.col("position").cast("long").alias("position"), decimal_minor(F.col("m.number")).alias("amount_minor"), currency(mark).alias("c"))
    return rows.where("amount_minor is not null").select(id_col, "position", "amount_minor", F.col("c.code").alias("currency"), F.col("c.confidence").alias("confidence"))


def useful_year(document_type: Column, iso_date: Column, confidence: Column) -> Column:
    """The year of a dated type's sure date; null otherwise."""
    return F.when(document_type.isin(*DATED_TYPES) & (confidence >= 0.85) & iso_date.rlike("^[0-9]{4}-"), F.substring(iso_date, 1, 4))


def adjusted(base: Column, q: Column) -> Column:
    """A confidence lowered by up to half for poor input."""
    return base * (0.5 + 0.5 * q)


def calibrated(raw: Column, slope: float, intercept: float, samples: int, unusual: Column, least: int = 30) -> Column:
    """A raw score through a fitted logistic curve; as it is for unusual input or a curve of too few samples."""
    return raw if samples < least else F.when(F.coalesce(unusual, F.lit(False)), raw).otherwise(1 / (1 + F.exp(-(slope * raw + intercept))))


# The labels of each type's fields.
FIELDS = {
    "invoice": {"invoice_number": ("facture no", "invoice number"), "customer": ("client", "customer"), "supplier": ("fournisseur", "supplier"), "issue_date": ("date de facture", "invoice date"), "total": ("total ttc", "amount due")},
    "quote": {"quote_number": ("devis no", "quote number"), "customer": ("client", "customer"), "amount": ("total ttc",)},
}


def business_fields(labelled: DataFrame, types: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, field, value)``: for each field of a document's type the value of its first label in a line ``(id_col, line, label, value)``."""
    rows = [(t, f, label, n) for t, fields in FIELDS.items() for f, labels in fields.items() for n, label in enumerate(labels)]
    table = F.broadcast(labelled.sparkSession.createDataFrame(rows, "document_type string, field string, label string, n int"))
    met = labelled.join(types.select(id_col, "document_type"), id_col).join(table, ["document_type", "label"])
    first = F.min(F.struct("n", "line", "value")).alias("b")
    return met.groupBy(id_col, "field").agg(first).select(id_col, "field", F.col("b.value").alias("value"))


# How a document's number is written behind its label, and words that no supplier's header holds.
DOCUMENT_NUMBER = r"(?i)\b(facture|invoice|devis|quote|quotation|estimate)\s*(?:number|no\.?|n[°o.]?|#)?\s*[:#.\-]?\s*([A-Z0-9][A-Z0-9._/\-]{2,47})\b"
NO_HEADER = ("facture", "invoice", "devis", "quote")
NUMBER_LABELS = {"invoice": ("facture", "invoice"), "quote": ("devis", "quote", "quotation", "estimate")}


def identifiers(docs: DataFrame, id_col: str, text: Column, document_type: Column, quality: Column, most: int = 8) -> DataFrame:
    """``(id_col, position, number, original, confidence)`` of the numbers behind a label of the document's type, among the first ``most`` labelled words.

    Numbers are upper-cased without marks at their ends; one without a digit, or shorter than three characters, is none. ``quality`` is between 0 and 1.
    """
    part = lambda g, name: F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOCUMENT_NUMBER), F.lit(g)), 1, most).alias(name)
    rows = docs.select(id_col, document_type.alias("_type"), quality.alias("_q"), F.posexplode(F.arrays_zip(part(1, "label"), part(2, "number"))).alias("position", "_m"))
    fits = reduce(lambda a, b: a | b, [(F.col("_type") == kind) & F.lower("_m.label").isin(*labels) for kind, labels in NUMBER_LABELS.items()])
    number = F.upper(F.regexp_replace("_m.number", r"^[._/\-]+|[._/\-]+$", ""))
    found = rows.where(fits).select(id_col, F.col("position").cast("long").alias("position"), number.alias("number"), F.col("_m.number").alias("original"), adjusted(F.lit(0.98), F.col("_q")).alias("confidence"))
    return found.where((F.length("number") >= 3) & F.col("number").rlike("[0-9]"))


def supplier_header(text: Column) -> Column:
    """The first of a text's first four lines that reads like a firm's name: at least seven tenths of its two or more letters capitals, at most 80 characters, no word of ``NO_HEADER``; null without."""
    lines = F.transform(F.slice(F.split(text, r"\r?\n"), 1, 4), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))

    def plausible(line: Column) -> Column:
        letters, capitals = F.length(F.regexp_replace(line, r"\P{L}+", "")), F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
        named = reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(w)) for w in NO_HEADER])
        return (letters >= 2) & (F.length(line) <= 80) & (capitals * 10 >= letters * 7) & ~named

    return F.get(F.filter(lines, plausible), F.lit(0))


def analysis_status(fields: DataFrame, quality: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, status)`` of every row of ``quality`` ``(id_col, band)`` by its ``fields`` ``(id_col, field, value, status)``.

    ``unknown`` without a field that says anything: one with a value, other than an unknown type or context. Else ``partial`` if the input is not
    good or a field is ambiguous or conflicting, and ``success`` if neither.
    """
    says = F.col("value").isNotNull() & ~(F.col("field").isin("document_type", "context") & (F.col("value") == "unknown"))
    held = fields.groupBy(id_col).agg(F.bool_or(says).alias("_says"), F.bool_or(F.col("status").isin("ambiguous", "conflicting")).alias("_open"))
    rows = quality.select(id_col, "band").join(held, id_col, "left")
    poor = (F.col("band") != "good") | F.coalesce("_open", F.lit(False))
    return rows.select(id_col, F.when(~F.coalesce("_says", F.lit(False)), "unknown").when(poor, "partial").otherwise("success").alias("status"))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per ``key``: the first in ``order``."""
    over = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def first_evidence(rows: DataFrame, key: list[str], most: int = 8) -> DataFrame:
    """``(key, evidence)``: the first ``most`` distinct pieces of evidence ``(kind, offset, text)`` of each key, by offset."""
    distinct = rows.select(*key, "kind", "offset", "text").distinct()
    over = Window.partitionBy(*key).orderBy("offset", "kind", "text")
    kept = distinct.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= most)
    return kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_e")).select(*key, F.col("_e.text").alias("evidence"))
