"""Column functions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that Windows reserves, and characters it forbids in names.
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{k}" for d in ("com", "lpt") for k in "123456789¹²³"))
FORBIDDEN = r'[<>:"\\|?*\x00-\x1f]'


def parent(path: str) -> Column:
    """What precedes the last slash; null at top level."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: str) -> Column:
    return F.size(F.split(path, "/")).cast("long")


def within(path: str, directory: str) -> Column:
    """The directory itself or what lies below it, by whole components."""
    return (F.col(path) == directory) | F.col(path).startswith(f"{directory}/")


def below(path: str, directory: str) -> Column:
    """What lies below a directory, itself not included."""
    return F.col(path).startswith(f"{directory}/") & (F.length(path) > len(directory) + 1)


def descendant_bounds(directory: str) -> tuple[str, str]:
    """Exclusive bounds, in byte order, between which exactly the descendants of a directory lie."""
    return f"{directory}/", f"{directory}{chr(ord('/') + 1)}"


def ancestors(path: str) -> Column:
    """Every proper ancestor, the nearest last; of a top-level path the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(path: str | Column) -> Column:
    """Only A-Z in small letters; other letters are told apart."""
    return F.translate(path, _UPPER, _LOWER)


def has(path: str | Column, needle: str, fold: bool = False) -> Column:
    """Whether the needle stands anywhere in the whole path; an empty one stands in every path."""
    return folded(path).contains(folded(F.lit(needle))) if fold else (F.col(path) if isinstance(path, str) else path).contains(needle)


def fault(path: str) -> Column:
    """The first rule that a path breaks; null if it is valid."""
    parts = F.split(path, "/")
    return (
        F.when(F.length(path) == 0, "empty")
        .when(F.exists(parts, lambda c: c == ""), "empty_component")
        .when(F.exists(parts, lambda c: c.isin(".", "..")), "dot_component")
        .when(F.col(path).contains("\0"), "nul")
        .when(F.exists(parts, lambda c: F.octet_length(c) > 1024), "component_too_long")
        .when(F.octet_length(path) > 16384, "too_long")
        .when(F.size(parts) > 1024, "too_deep")
    )


def windows_issue_of(component: Column) -> Column:
    """Why a name cannot be used on Windows; null if it can. The device is named by what precedes the first
    period, blanks at its end ignored. U+FFFD stands for bytes that were no text."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(component, r"\."), 1), "[ \t\n\f\r]+$", ""))
    return (
        F.when(component.contains("\ufffd"), "not_representable")
        .when(component.rlike(FORBIDDEN), "illegal_character")
        .when(component.rlike("[. ]$"), "trailing_dot_or_space")
        .when(stem.isin(*RESERVED), "reserved_name")
    )


def windows_issue(component: str) -> Column:
    return windows_issue_of(F.col(component))


def case_key(component: Column) -> Column:
    """The key under which a destination without case holds a name: lower case by Unicode's full mapping;
    stretches that are no text stay as they are."""
    return F.lower(component)
