"""Normal forms of names, addresses, path components and values, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms of companies, names that Windows keeps for devices, names that say nothing about a file.
LEGAL_FORMS = (
    "sas", "sasu", "sarl", "sa", "eurl", "scop", "sei", "llc", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "gmbh", "ag", "bv", "nv", "plc",
)
SPACED_FORMS = {"s a s": "sas", "s a r l": "sarl", "s a": "sa", "l l c": "llc"}
RESERVED_NAME = r"(?i)^(con|prn|aux|nul|(com|lpt)[1-9])([.].*)?$"
INVALID_CHARACTER = r'[<>:"|?*\x00-\x1F]'
PLAIN_LENGTH = 64
PLAIN_NAME = r"(?i)^(?!(?:con|prn|aux|nul|(?:com|lpt)[1-9])(?:[.]|\z))[0-9a-z#_](?:[0-9a-z#_ .-]{0,62}[0-9a-z#_-])?\z"
"""Names of at most ``PLAIN_LENGTH`` ASCII characters that are valid components as they are: one pattern tells, where all faults take many."""
GENERIC_PREFIXES = ("scan", "img", "image", "document", "file")
SEMANTIC_ROOTS = ("business", "entreprise", "professional", "professionnel", "personal", "personnel")


def search_form(text: Column, most: int = 512) -> Column:
    """Compatibility-decomposed, without combining marks, lower-cased, apostrophes and blanks of one kind, ``most`` characters; null stays null."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    out = F.translate(F.lower(folded(text)), "’‘`  ", "'''  ")
    return F.substring(F.btrim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def name_parts(name: Column) -> Column:
    """``struct<exact, core, form>``: letters and digits in lower case with single blanks between, the same without a legal form, and that form (null without)."""
    exact = F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    spaced = F.regexp_extract(exact, "^(?:.* )?(" + "|".join(SPACED_FORMS) + ")$", 1)
    plain = F.regexp_extract(exact, "^(?:.* )?(" + "|".join(LEGAL_FORMS) + ")$", 1)
    forms = F.create_map(*[F.lit(x) for pair in SPACED_FORMS.items() for x in pair])
    found = F.when(spaced != "", spaced).when(plain != "", plain)
    core = F.btrim(F.left(exact, F.length(exact) - F.length(F.coalesce(found, F.lit("")))))
    return F.struct(exact.alias("exact"), core.alias("core"), F.coalesce(forms[found], found).alias("form"))


def title_case(name: Column) -> Column:
    """Words begin with a capital, if the name has no lower-case letter at all; others stay."""
    return F.when(name.rlike(r"\p{Ll}"), name).otherwise(F.initcap(F.lower(name)))


def domain(value: Column) -> Column:
    """A lower-case host name of dotted ASCII labels; null unless it is one."""
    low = F.lower(F.btrim(F.btrim(value), F.lit(".")))
    return F.when(low.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?[.])+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$") & (F.length(low) <= 253), low)


def email(value: Column) -> Column:
    """A lower-case address with a valid local part of at most 64 characters and a valid domain; null unless it is one."""
    low = F.lower(F.btrim(value))
    local, host = F.substring_index(low, "@", 1), domain(F.substring_index(low, "@", -1))
    good = (F.length(low) <= 254) & (F.length(low) - F.length(F.replace(low, F.lit("@"), F.lit(""))) == 1) & F.length(local).between(1, 64)
    shaped = local.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+([.][a-z0-9!#$%&'*+/=?^_`{|}~-]+)*$")
    return F.when(good & shaped & host.isNotNull(), F.concat(local, F.lit("@"), host))


def entity_value(value: Column) -> Column:
    """Single blanks, and no ASCII marks at the ends but ``@``, ``+`` and ``-``."""
    flat = F.btrim(F.regexp_replace(value, r"\s+", " "))
    return F.regexp_replace(flat, r"^[!-*,./:-?\[-`{-~]+|[!-*,./:-?\[-`{-~]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points beyond U+FFFF count twice. ASCII is not searched for them."""
    beyond = F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")))
    return F.length(text) + beyond


def safe_component(name: Column, most: int = 120) -> Column:
    """A file or folder name that Windows takes: runs of invalid characters are one underscore, no blanks or dots at the end, reserved names get an underscore.

    Names of more than ``most`` characters are cut before their ending of up to 16 characters.
    """
    flat = F.regexp_replace(F.btrim(name), r'[<>:"|?*/\\\x00-\x1F]+', "_")
    flat = F.regexp_replace(flat, "[ .]+$", "")
    flat = F.when(flat == "", "Unclassified").otherwise(flat)
    flat = F.when(flat.rlike(RESERVED_NAME), F.concat(F.lit("_"), flat)).otherwise(flat)
    ending = F.regexp_extract(flat, r"^.+([.][^.]{1,16})$", 1)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.left(flat, most - F.length(ending)), ending))


def component_fault(name: Column, most: int = 120) -> Column:
    """Why a name is no valid path component: empty, traversal, drive, invalid, reserved or too_long; null for a valid one."""
    known = F.when(name.rlike(PLAIN_NAME), F.lit(None).cast("string")) if most >= PLAIN_LENGTH else F
    return (
        known.when(F.btrim(F.coalesce(name, F.lit(""))) == "", "empty").when(name.isin(".", "..") | name.rlike(r"[/\\]"), "traversal")
        .when(name.rlike("^[A-Za-z]:"), "drive").when(name.rlike(INVALID_CHARACTER) | name.rlike("[ .]$"), "invalid").when(name.rlike(RESERVED_NAME), "reserved")
        .when(utf16_length(name) > most, "too_long")
    )


def collision_key(folders: Column, name: Column) -> Column:
    """What two destinations have in common if they clash: all components in lower case, joined by backslashes."""
    return F.lower(F.array_join(F.array_append(folders, name), "\\"))


def collision_name(name: Column, ordinal: Column, most: int = 120) -> Column:
    """``stem_N.ending`` within ``most`` characters."""
    stem, ending = F.regexp_extract(name, r"^(.+?)([.][^.]{1,16})?$", 1), F.regexp_extract(name, r"^(.+?)([.][^.]{1,16})?$", 2)
    suffix = F.concat(F.lit("_"), ordinal.cast("string"))
    return F.concat(F.left(stem, F.greatest(most - F.length(suffix) - F.length(ending), F.lit(1))), suffix, ending)


def generic_name(name: Column) -> Column:
    """Whether a file's name says nothing: a scanner's or camera's prefix, a bare ``facture`` or ``invoice``, or at least half digits."""
    stem = F.lower(F.regexp_replace(name, r"[.][^.]*$", ""))
    digits = F.length(stem) - F.length(F.regexp_replace(stem, "[0-9]", ""))
    return stem.rlike("^(" + "|".join(GENERIC_PREFIXES) + ")([_-].*)?$") | stem.isin("facture", "invoice") | (digits >= F.floor(F.octet_length(stem) / 2))


def path_parts(path: Column) -> Column:
    """Components of a path, split at either slash, blank ones left out."""
    return F.filter(F.split(path, r"[/\\]"), lambda p: F.btrim(p) != "")


def parent_parts(path: Column, name: Column) -> Column:
    """Folders of a path: its components without the file's name at the end, whatever its case."""
    parts = path_parts(path)
    own = F.lower(F.get(parts, F.size(parts) - 1)) == F.lower(name)
    return F.when(own, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def structure_useful(source: Column, proposed: Column, most_depth: int = 8) -> Column:
    """Whether the folders a file lies in are worth keeping: they begin with a known root, are valid, and two of them, and half of the shorter path, are proposed too."""
    low = F.transform(source, F.lower)
    wanted = F.array_distinct(F.transform(proposed, F.lower))
    met = F.size(F.filter(low, lambda p: F.array_contains(wanted, p)))
    valid = F.forall(source, lambda p: component_fault(p).isNull()) & F.size(source).between(1, most_depth)
    return valid & F.coalesce(F.get(low, 0).isin(*SEMANTIC_ROOTS), F.lit(False)) & (met >= 2) & (met * 2 >= F.least(F.size(source), F.size(wanted)))


def disruption(source: Column, destination: Column, old_name: Column, new_name: Column) -> Column:
    """0 to 1, how much a move disturbs: .85 of the share of folders that the paths do not share, and .15 for a new name."""
    a, b = (F.array_distinct(F.transform(c, F.lower)) for c in (source, destination))
    renamed = F.when(F.lower(old_name) == F.lower(new_name), 0.0).otherwise(0.15)
    longer = F.greatest(F.size(a), F.size(b), F.lit(1))
    same = F.lower(F.array_join(source, "/")) == F.lower(F.array_join(destination, "/"))
    apart = F.when(same, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / longer)
    return F.when(same & (renamed == 0), 0.0).otherwise(F.least(apart * 0.85 + renamed, F.lit(1.0)))


def text_list(items: Column) -> Column:
    """A list as it is shown: comma-joined."""
    return F.array_join(items, ", ")


def value_key(kind: Column, value: Column) -> Column:
    """A key under which equal values of one kind meet, whatever their letter case and blanks."""
    return F.concat_ws(":", kind, F.lower(entity_value(value)))


def signature(kind: Column, key: Column) -> Column:
    """SHA-256 of a pattern's kind and key, so a suggestion keeps its identity."""
    return F.sha2(F.concat_ws("\n", kind, key).cast("binary"), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Share of the distinct elements of two arrays that both have; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    """Tokens of a text at three characters each, rounded up."""
    return F.ceil(F.length(text) / 3).cast("long")


def truncated(text: Column, most_tokens: int) -> Column:
    """The longest beginning of a text whose estimate stays within ``most_tokens``."""
    return F.left(text, F.lit(3 * most_tokens))


def metadata_summary(filename: Column, fields: Column, identities: Column, most: int = 24) -> Column:
    """Lines ``filename: …``, ``name: value`` for the first fields of a map-entry array, and ``identity: …``; empty values give no line."""
    named = F.transform(F.slice(F.filter(fields, lambda f: f["value"] != ""), 1, most), lambda f: F.concat(f["name"], F.lit(": "), f["value"]))
    held = F.transform(F.slice(F.filter(identities, lambda i: i != ""), 1, most), lambda i: F.concat(F.lit("identity: "), i))
    return F.concat_ws("\n", F.concat(F.lit("filename: "), filename), named, held)


def valid_vector(v: Column, dimensions: int) -> Column:
    """Right length, finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & (squared(v) > 1e-12), F.lit(False))


def squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def unit(v: Column) -> Column:
    """A vector divided by its length; a zero vector stays."""
    n = F.sqrt(squared(v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
