"""Text functions of the engine as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds that carry an embedding, and all node kinds (fixed values of the graph's vocabulary).
EMBEDDABLE = ("Module", "Class", "Function", "Example")
KINDS = ("Library", "Module", "Class", "Function", "Parameter", "ReturnType", "Exception", "Example")
LINK_TYPES = ("CONTAINS", "DECLARES", "HAS_METHOD", "HAS_PARAM", "RETURNS", "RAISES", "USES_EXAMPLE", "CALLS", "INHERITS")


def text(c: Column | str) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` only takes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen; ``unknown`` if nothing is left."""
    hyphened = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(hyphened, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def graph_id(library: Column, version: Column) -> Column:
    return F.concat_ws(":", slug(library), F.coalesce(strip_or_null(version), F.lit("unknown")))


def node_id(graph: Column, kind: Column, qualified: Column) -> Column:
    return F.concat_ws(":", graph, kind, qualified)


def words(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of the lowered text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-zA-Z0-9_]+)"))


def blank_separated(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")


def hash_tokens(c: Column) -> Column:
    """Tokens of the hash embedding: bars, round brackets and commas separate as white space does."""
    return F.filter(F.split(F.translate(F.lower(c), "|(),", "    "), r"(?U)\s+"), lambda x: x != "")


def haystack() -> Column:
    """The searched text of a node row (current rows with an ``embedding_text`` column)."""
    parts = ("name", "qualified_name", "summary", "docstring", "signature", "embedding_text")
    return F.lower(F.concat_ws(" ", *[text(p) for p in parts]))


def embedding_text() -> Column:
    """What is embedded for a node: its non-empty parts between bars."""
    parts = F.array(*[text(p) for p in ("kind", "qualified_name", "summary", "signature", "docstring")])
    return strip(F.array_join(F.filter(parts, lambda x: x != ""), " | "))


def embedding_text_keeping_empty() -> Column:
    """The variant of the index profile: empty parts are kept, outer bars and blanks are not."""
    parts = [text(p) for p in ("kind", "qualified_name", "summary", "signature", "docstring")]
    return F.regexp_replace(F.concat_ws(" | ", *parts), r"^[ |]+|[ |]+\z", "")


def first_line(c: Column, fallback: Column) -> Column:
    """The first line that is not blank, without outer white space, or else the fallback."""
    lines = F.filter(F.transform(F.split(c, r"\R"), strip), lambda x: x != "")
    return F.coalesce(F.get(lines, 0), fallback)


def compress(items: Column, n: int) -> Column:
    """The first ``n`` items that are not blank, between bars."""
    return F.array_join(F.slice(F.filter(F.transform(items, strip), lambda x: x != ""), 1, n), " | ")


def last_part(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def package_name(c: Column) -> Column:
    return F.translate(c, "-", "_")


def distribution_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[-_.]+", "-"))


def utc_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _set(c: Column, key: str) -> Column:
    """The text that a line ``key = "..."`` sets, or null."""
    return strip_or_null(F.regexp_extract(c, rf"""(?m)^{key} *= *["']([^"'\n]*)["']""", 1))


def declared_name(c: Column) -> Column:
    """The name that a project file declares."""
    return _set(c, "name")


def declared_version(c: Column) -> Column:
    """The version that a project file declares, or else the ``__version__`` of a module."""
    return F.coalesce(_set(c, "version"), _set(c, "__version__"))
