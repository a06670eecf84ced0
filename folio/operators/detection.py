"""What a file is, from its name and first bytes, and whether and how it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of each kind of content, leading bytes of each kind (hex), names that are never catalogued.
KIND_EXTENSIONS = {
    "text": ("txt", "md", "markdown", "csv", "tsv", "json", "xml", "log"), "pdf": ("pdf",), "docx": ("docx",), "xlsx": ("xlsx",), "pptx": ("pptx",),
    "zip": ("zip",), "image": ("png", "jpg", "jpeg", "webp", "tif", "tiff", "gif", "bmp"), "video": ("mp4", "mov", "webm", "mkv", "avi"),
    "legacy_office": ("doc", "xls", "ppt"), "executable": ("exe", "dll", "com", "msi", "app", "dmg", "so", "dylib"),
}
MAGIC = [
    ("pdf", "^255044462D"), ("zip", "^504B(0304|0506|0708)"), ("legacy_office", "^D0CF11E0A1B11AE1"), ("executable", "^(4D5A|7F454C46)"),
    ("image", "^(89504E470D0A1A0A|FFD8FF|474946383[79]61|49492A00|4D4D002A|52494646.{8}57454250)"), ("video", "^(1A45DFA3|.{8}66747970)"),
]
TEMPORARY_NAME = r"(^[.]|^~[$]|~$|[.](tmp|temp|part|partial|crdownload|swp)$)"
EXCLUDED_FOLDERS = (".git", ".svn", ".hg", "node_modules", "target", "cache", "caches", "tmp", "temp", "$recycle.bin", "system volume information")
PROGRAM_FOLDERS = (
    "program files", "program files (x86)", "windows", "system32", "syswow64", "applications", "library", "system", "appdata", "node_modules", "contents",
)
SYSTEM_EXTENSIONS = ("dll", "sys", "dylib", "so", "bundle", "framework")
OFFICE = ("docx", "xlsx", "pptx")
WHOLE_LIMIT = {"pdf": 64 << 20, "docx": 64 << 20, "xlsx": 64 << 20, "pptx": 64 << 20, "image": 64 << 20, "zip": 256 << 20}
"""Bytes up to which a kind is read whole; a parameter of ``extraction_plan``."""


def _chain(pairs: list[tuple[Column, str]], other: Column | str | None) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out.otherwise(other)


def extension_of(filename: Column) -> Column:
    """Lower-cased characters after the last dot; null for names without one or that only begin with one."""
    found = F.regexp_extract(F.lower(filename), r"^.+[.]([^.]+)$", 1)
    return F.when(found != "", found)


def expected_kind(extension: Column) -> Column:
    """The kind that an extension promises; null where it promises nothing."""
    return _chain([(F.lower(extension).isin(*names), kind) for kind, names in KIND_EXTENSIONS.items()], F.lit(None).cast("string"))


def magic_kind(prefix: Column) -> Column:
    """The kind that leading bytes (binary) prove; null where none does."""
    hexed = F.hex(F.substring(prefix, 1, 16))
    return _chain([(hexed.rlike(pattern), kind) for kind, pattern in MAGIC], F.lit(None).cast("string"))


def looks_like_text(prefix: Column) -> Column:
    """Not empty, no NUL, valid UTF-8 and at most one control character in a hundred (tab and line ends aside)."""
    text = F.decode(F.coalesce(prefix, F.lit(b"")), "UTF-8")
    valid = F.coalesce(F.is_valid_utf8(prefix.cast("string")), F.lit(False))
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))
    return F.when(valid, (F.length(text) > 0) & ~F.contains(text, F.lit("\0")) & (controls * 100 <= F.length(text))).otherwise(False)


def detect(files: DataFrame, filename: str, prefix: str) -> DataFrame:
    """``files`` with ``kind`` and ``mismatch``.

    Bytes win over the name; a zip archive may be any Office format its name promises. Without known bytes the name
    holds, except that promised text must look like text, and valid text without a known name is text.
    """
    expected, magic, readable = expected_kind(extension_of(F.col(filename))), magic_kind(F.col(prefix)), looks_like_text(F.col(prefix))
    office = (magic == "zip") & expected.isin(*OFFICE)
    kind = (
        F.when(office, expected).when(magic.isNotNull(), magic).when((expected == "text") & ~readable, "unknown")
        .when(expected.isNotNull(), expected).when(readable, "text").otherwise("unknown")
    )
    clash = F.coalesce(expected.isNotNull() & magic.isNotNull() & ~office & (expected != magic), F.lit(False))
    return files.withColumns({"kind": kind, "mismatch": clash})


def extraction_plan(files: DataFrame, size: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Detected ``files`` with ``plan`` (read_prefix, read_whole, failed, unsupported, skipped) and ``reason``."""
    kind, limits = F.col("kind"), WHOLE_LIMIT if limits is None else limits
    over = F.lit(False)
    for name, most in limits.items():
        over = over | ((kind == name) & (F.col(size) > most))
    refused = kind.isin("legacy_office", "executable", "unknown")
    plan = F.when(F.col("mismatch"), "failed").when(refused, "unsupported").when(F.coalesce(over, F.lit(False)), "skipped").when(kind.isin("text", "video"), "read_prefix").otherwise("read_whole")
    named = F.create_map(*[F.lit(x) for pair in (("failed", "type_mismatch"), ("unsupported", "unsupported"), ("skipped", "too_large")) for x in pair])
    return files.withColumn("plan", plan).withColumn("reason", named[F.col("plan")])


def excluded(path: Column) -> Column:
    """Hidden, temporary and cache paths, and everything inside application bundles; a path without a name is excluded."""
    parts = F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), r"[/\\]"), lambda p: p != "")
    name = F.get(F.reverse(parts), 0)
    folder = F.exists(parts, lambda p: p.isin(*EXCLUDED_FOLDERS) | F.endswith(p, F.lit(".app")))
    return F.coalesce(name.rlike(TEMPORARY_NAME), F.lit(True)) | folder


def excluded_by_user(path: Column, prefixes: list[str], extensions: list[str]) -> Column:
    """Whether a path lies in one of the user's folders or has one of their extensions."""
    inside = [(path == p.rstrip("/")) | F.startswith(path, F.lit(p.rstrip("/") + "/")) for p in prefixes]
    kinds = [F.endswith(F.lower(path), F.lit("." + e.lower())) for e in extensions]
    out = F.lit(False)
    for c in inside + kinds:
        out = out | c
    return F.coalesce(out, F.lit(False))


def is_program(path: Column) -> Column:
    """Files of programs and systems, which stay where they are."""
    parts = F.split(F.lower(path), r"[/\\]")
    bundle = F.exists(parts, lambda p: p.isin(*PROGRAM_FOLDERS) | p.rlike(r"[.](app|framework)$"))
    return F.coalesce(bundle | extension_of(F.get(F.reverse(parts), 0)).isin(*SYSTEM_EXTENSIONS), F.lit(False))


def is_installer(filename: Column) -> Column:
    """Disk images and packages, installers by name, and Windows packages that are no system update."""
    low, ext = F.lower(filename), extension_of(filename)
    named, system = low.rlike("setup|install"), low.rlike("kb|hotfix|update|^windows")
    return F.coalesce(ext.isin("dmg", "pkg") | ((ext == "msi") & (named | ~system)) | ((ext == "exe") & named), F.lit(False))


def safe_archive_path(name: Column) -> Column:
    """An archive entry that stays below where it is unpacked: relative, no drive, backslash, NUL or parent step."""
    return F.coalesce((F.length(name) > 0) & ~name.rlike(r"^/|\\|\x00|^.:|(^|/)[.][.](/|$)"), F.lit(False))


def suspicious_ratio(size: Column, packed: Column, most: int = 1000) -> Column:
    """Entries that unpack to more than ``most`` times their packed size, or to something from nothing."""
    return F.when(packed == 0, size > 0).otherwise(F.floor(size / packed) > most)
