"""File names: extensions, kinds, ignored names, type groups, paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import IGNORED_PREFIXES, IGNORED_SUFFIXES, KIND_BY_EXT, TYPE_GROUPS


def extension(name: Column) -> Column:
    """The lower-case extension with its dot; none for names that only start with dots."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1))


def kind_of(name: Column) -> Column:
    """pdf, office or text; null for other files."""
    ext = extension(name)
    return F.coalesce(*[F.when(ext.isin(*[e for e, k in KIND_BY_EXT.items() if k == kind]), kind) for kind in ("pdf", "office", "text")])


def ignored_name(name: Column) -> Column:
    """Lock, temporary and hidden files."""
    out = F.lit(False)
    for p in IGNORED_PREFIXES:
        out = out | name.startswith(p)
    for s in IGNORED_SUFFIXES:
        out = out | name.endswith(s)
    return out


def allowed_extensions(groups: Iterable[str] | None) -> list[str]:
    """Extensions that a filter of groups or single extensions lets through; no filter lets all supported ones."""
    wanted = [e for g in groups or [] for e in TYPE_GROUPS.get(g, [g if g.startswith(".") else f".{g}"])]
    return sorted(set(KIND_BY_EXT) & set(wanted)) if groups else sorted(KIND_BY_EXT)


def normal_path(path: str) -> tuple[str, tuple[str, ...]]:
    """(kind, parts) of an absolute path: a drive like ``c:``, ``//host`` for shares, or ``/``. No way up is allowed."""
    text = path.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1].strip()
    if not text.startswith("/"):  # in a POSIX path a backslash is a character like any other
        text = text.replace("\\", "/")
    if len(text) >= 2 and text[1] == ":" and text[0].isalpha():
        kind, rest = text[:2].lower(), text[2:]
    elif text.startswith("//"):
        host, _, rest = text[2:].partition("/")
        kind = f"//{host.lower()}"
    elif text.startswith("/"):
        kind, rest = "/", text
    else:
        raise ValueError(f"not an absolute path: {path}")
    parts = tuple(p for p in rest.split("/") if p not in ("", "."))
    if ".." in parts:
        raise ValueError(f"path leaves its root: {path}")
    return kind, parts


def find_root(path: str, roots: Iterable[str]) -> tuple[str, str] | None:
    """The most specific root that a path lies under, and the path below it; drives and shares ignore case."""
    kind, parts = normal_path(path)
    fold = (lambda p: p) if kind == "/" else str.lower
    best = None
    for root in roots:
        root_kind, root_parts = normal_path(root)
        n = len(root_parts)
        if root_kind == kind and tuple(map(fold, parts[:n])) == tuple(map(fold, root_parts)) and (best is None or n > best[0]):
            best = (n, root, "/".join(parts[n:]))
    return best and best[1:]
