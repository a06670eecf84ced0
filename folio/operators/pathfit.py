"""Paths that Windows takes: lengths in UTF-16 units, and one budget for all folders and the name of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import bound
from folio.operators.normalise import PLAIN_LENGTH, PLAIN_NAME, RESERVED_NAME, component_fault, utf16_length

PATH, SEGMENT, FILENAME, SHORT, LEAST_NAME = 240, 80, 160, 32, 16
"""Units of a whole path, of a folder, of a file's name, of a folder that is shortened, and what a name keeps at least."""
ENDING = r"^(?:.+)[.]([^.]+)$"
BEYOND = r"[\x{10000}-\x{10FFFF}]"
PLAIN = r"(?!(?:con|prn|aux|nul|(?:com|lpt)[1-9])(?:[.\\]|\z))[0-9a-z#_](?:[0-9a-z#_ .-]{0,62}[0-9a-z#_-])?"
PLAIN_PATH = rf"(?i)^(?:{PLAIN}\\)*{PLAIN}\z"
"""Paths of short ASCII components that are valid as they are."""


def cut(text: Column, most: Column | int) -> Column:
    """The longest start of ``text`` within ``most`` UTF-16 units; no code point is halved."""
    most = F.lit(most) if isinstance(most, int) else most
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        # counts how many code points fit; only texts beyond the basic plane need it
        units = F.when(c.rlike(BEYOND), 2).otherwise(1)
        fits = acc["open"] & (acc["used"] + units <= most)
        return F.struct((acc["n"] + fits.cast("int")).alias("n"), (acc["used"] + units).alias("used"), fits.alias("open"))

    def shorter(t: Column) -> Column:
        points = F.aggregate(F.split(F.left(t, most), ""), start, step, lambda acc: acc["n"])
        # no text has more units than bytes
        return F.when(F.octet_length(t) <= most, t).when(~t.rlike(BEYOND), F.left(t, most)).when(utf16_length(t) <= most, t).otherwise(F.left(t, points))

    return bound(text, shorter)


def ending(name: Column) -> Column:
    """The last dot and what follows, if it and a stem are there and it has at most 16 units; else empty."""
    return bound(F.regexp_extract(name, ENDING, 1), lambda e: F.when((e != "") & (utf16_length(e) <= 16), F.concat(F.lit("."), e)).otherwise(""))


def cut_name(name: Column, most: Column | int) -> Column:
    """``name`` within ``most`` units, cut before its ending if that leaves anything of the stem."""
    most = F.lit(most) if isinstance(most, int) else most

    def before(n: Column, e: Column) -> Column:
        room = most - utf16_length(e)
        return F.when((e == "") | (room <= 0), cut(n, most)).otherwise(F.concat(cut(F.left(n, F.length(n) - F.length(e)), room), e))

    return bound(name, lambda n: F.when(utf16_length(n) <= most, n).otherwise(bound(ending(n), lambda e: before(n, e))))


def safe(name: Column, most: int, keep_ending: bool) -> Column:
    """A path component that Windows takes: runs of invalid characters are one underscore, no blank or dot at the end, no reserved name, at most ``most`` units."""
    def made(n: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(F.btrim(n), r'[<>:"|?*/\\\x00-\x1F\x7F-\x{9F}]+', "_"), "[ .]+$", "")
        known = bound(flat, lambda f: F.when(f == "", "Unclassified").when(f.rlike(RESERVED_NAME), F.concat(F.lit("_"), f)).otherwise(f))
        return cut_name(known, most) if keep_ending else cut(known, most)

    return bound(name, lambda n: F.when(n.rlike(PLAIN_NAME), n).otherwise(made(n))) if most >= PLAIN_LENGTH else made(name)


def path_length(folders: Column, name: Column) -> Column:
    """Units of a path: its components and one separator a folder; null if one of them is."""
    known = name.isNotNull() & ~F.exists(folders, lambda f: f.isNull())
    return F.when(known, bound(F.array_join(F.array_append(folders, name), "\\"), utf16_length))


def valid_destination(folders: Column, depth: int) -> Column:
    """Whether folders that a user names can be taken as they are; null is not valid."""
    return F.coalesce((F.size(folders) <= depth) & ~F.exists(folders, lambda f: component_fault(f, SEGMENT).isNotNull()), F.lit(False))


def numbered_name(name: Column, number: Column) -> Column:
    """``stem_N.ending`` within the units of a file's name."""
    suffix = F.concat(F.lit("_"), number.cast("string"))

    def made(e: Column) -> Column:
        stem = F.left(name, F.length(name) - F.length(e))
        return F.concat(cut(stem, F.greatest(F.lit(FILENAME) - F.length(suffix) - utf16_length(e), F.lit(1))), suffix, e)

    return bound(ending(name), made)


def fitted(rows: DataFrame, folders: str, name: str, depth: int, most: int = PATH) -> DataFrame:
    """``rows`` with ``fit`` ``(folders, name, changed, valid)``: a machine-made path within ``depth`` folders and ``most`` units.

    Components are made safe first. While the path is too long its folders are cut to 32 units from the last to the first, in one fold that
    carries the length left; then the name is cut to what remains, but never below 16 units. ``valid`` says whether it fits at last. A null
    name counts as empty.
    """
    path = F.array_join(F.array_append(folders, F.col(name)), "\\", "?")
    rows = rows.withColumn("_path", path)
    # nothing is to be done for a path that one pattern finds plain and whose components hold no separator
    own = F.length("_path") - F.length(F.replace("_path", F.lit("\\"), F.lit(""))) == F.size(folders)
    rows = rows.withColumn("_plain", F.coalesce((F.size(folders) <= depth) & (F.length("_path") <= most) & own & F.rlike("_path", F.lit(PLAIN_PATH)), F.lit(False))).drop("_path")
    made = F.transform(F.coalesce(F.col(folders), F.array().cast("array<string>")), lambda f: safe(f, SEGMENT, False))
    called = safe(F.coalesce(F.col(name), F.lit("")), FILENAME, True)
    rows = rows.withColumns({"_made": F.when(~F.col("_plain"), F.slice(made, 1, depth)), "_called": F.when(~F.col("_plain"), called)})
    start = F.struct(path_length(F.col("_made"), F.col("_called")).alias("left"), F.array().cast("array<string>").alias("done"))

    def shorten(acc: Column, f: Column) -> Column:
        piece = F.when(acc["left"] > most, cut(f, SHORT)).otherwise(f)
        return bound(piece, lambda p: F.struct((acc["left"] - utf16_length(f) + utf16_length(p)).alias("left"), F.array_prepend(acc["done"], p).alias("done")))

    rows = rows.withColumn("_start", start)
    rows = rows.withColumn("_fold", F.when(F.col("_start.left") <= most, F.struct(F.col("_start.left").alias("left"), F.col("_made").alias("done"))).otherwise(F.aggregate(F.reverse("_made"), F.col("_start"), shorten)))
    room = F.greatest(F.lit(most) - (F.col("_fold.left") - utf16_length(F.col("_called"))), F.lit(LEAST_NAME))
    last = F.when(F.col("_fold.left") > most, cut_name(F.col("_called"), room)).otherwise(F.col("_called"))
    rows = rows.withColumn("_last", last)
    changed = ~(F.col("_fold.done").eqNullSafe(F.col(folders)) & F.col("_last").eqNullSafe(F.col(name)))
    valid = path_length(F.col("_fold.done"), F.col("_last")) <= most
    fit = F.struct(F.col("_fold.done").alias("folders"), F.col("_last").alias("name"), changed.alias("changed"), valid.alias("valid"))
    plain = F.struct(F.col(folders).alias("folders"), F.col(name).alias("name"), F.lit(False).alias("changed"), F.lit(True).alias("valid"))
    return rows.withColumn("fit", F.when(F.col("_plain"), plain).otherwise(fit)).drop("_plain", "_made", "_called", "_start", "_fold", "_last")
