"""Scalar functions over header values, paths and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def header_value(c: Column) -> Column:
    """A header on one line: each CR and LF is a space."""
    return strip(F.regexp_replace(blank_if_null(c), r"[\r\n]", " "))


def sanitize_header(c: Column) -> Column:
    """Runs of CR, LF and tab become one space."""
    return strip(F.regexp_replace(blank_if_null(c), r"[\r\n\t]+", " "))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def body_markup(c: Column) -> Column:
    """Escaped text with a break per line end."""
    return F.replace(escape_html(blank_if_null(c)), F.lit("\n"), F.lit("<br/>"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The file name without its last suffix; a name that is only a suffix stays."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def has_suffix(path: Column, suffix: str) -> Column:
    """Whether the path ends in a suffix such as ``.eml``, in any case, after a name."""
    return F.lower(path).rlike(rf"[^/.]\{suffix}$")


def relative_path(path: Column, root: Column) -> Column:
    """The part of ``path`` below ``root``; the whole path if it isn't below it."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def output_pdf_name(index: Column, path: Column, root: Column) -> Column:
    """Ordinal, cleaned stem and digest of the relative path: the name of a message's PDF."""
    stem = F.substring(F.regexp_replace(file_stem(path), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    digest = F.substring(F.sha2(F.encode(relative_path(path, root), "UTF-8"), 256), 1, 16)
    return F.concat(F.format_string("%08d_", index.cast("long")), F.when(stem == "", "email").otherwise(stem), F.lit("_"), digest, F.lit(".pdf"))


def display_path(path: Column, case_dir: Column) -> Column:
    """The path from the case directory's name on, or whole."""
    return relative_path(path, F.regexp_replace(F.regexp_replace(case_dir, "/+$", ""), r"/[^/]+$", ""))


def normalize_email(c: Column) -> Column:
    """Stripped lower case address; null unless text stands on both sides of the first @."""
    clean = F.lower(strip(c))
    at = F.instr(clean, "@")
    return F.when((at > 1) & (at < F.length(clean)), clean)


def email_list(c: Column) -> Column:
    """Distinct normalised addresses of a text split at line ends and commas, in order of appearance."""
    parts = F.split(blank_if_null(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029},]")
    return F.array_distinct(F.filter(F.transform(parts, normalize_email), lambda x: x.isNotNull()))


def fingerprint(addresses: Column) -> Column:
    """Digest of a set of addresses, whatever their order."""
    clean = F.filter(F.transform(addresses, normalize_email), lambda x: x.isNotNull())
    return F.sha2(F.encode(F.array_join(F.array_sort(F.array_distinct(clean)), "\n"), "UTF-8"), 256)


def archive_slug(path: Column) -> Column:
    """Short name of an archive: its stem, or the local part of an address with a trailing number."""
    stem = F.lower(file_stem(path))
    at = F.instr(stem, "@")
    local, rest = F.substring_index(stem, "@", 1), F.substr(stem, at + 1)
    number = F.regexp_extract(rest, r"(?:^|[._-])(\d+)$", 1)
    base = F.when(at == 0, stem).when(number != "", F.concat_ws("-", local, number)).otherwise(local)
    slug = F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", "pst").otherwise(slug)


def slug_with_digest(slug: Column, path: Column) -> Column:
    """A slug told apart by eight digits of the file name's digest."""
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(F.encode(file_name(path), "UTF-8"), 256), 1, 8))


def slug_list(c: Column) -> Column:
    """Items of a comma list, stripped, blanks dropped, repeats kept."""
    return F.filter(F.transform(F.split(blank_if_null(c), ","), strip), lambda x: x != "")


def joined_attachments(names: Column) -> Column:
    """Attachment names as one manifest field."""
    return F.array_join(names, "|")


def number_text(c: Column, decimals: int = 0) -> Column:
    return F.format_number(c, decimals)


def bytes_text(n: Column) -> Column:
    """1024-based size with one decimal."""
    n = n.cast("double")
    out = F.concat(F.format_number(n / 1024.0**5, 1), F.lit(" PB"))
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        scaled = n / 1024.0**power
        out = F.when(scaled < 1024.0, F.concat(F.format_number(scaled, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def elapsed_text(seconds: Column) -> Column:
    """HH:MM:SS with as many hours as there are."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60)


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def addresses_in(c: Column) -> Column:
    """Lower case addresses that occur in a header, in order. For exact parsing see ``participants``."""
    return F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(r"""([^\s<>,;:"()\[\]]+@[^\s<>,;:"()\[\]]+)"""), 1)
