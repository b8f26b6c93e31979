"""Tag filters. Untagged rows pass `any` and `all` and fail the strict modes; no requested tags means no filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("any", "all", "any_strict", "all_strict")


def tag_filter(tags: Column, wanted: list[str] | None, mode: str = "any") -> Column:
    if mode not in MODES:
        raise ValueError(f"tag mode {mode!r} is none of {MODES}")
    if not wanted:
        return F.lit(True)
    bare = tags.isNull() | (F.size(tags) == 0)
    asked = F.array(*[F.lit(t) for t in wanted])
    if mode.startswith("any"):
        hit = F.coalesce(F.arrays_overlap(F.filter(tags, lambda t: t.isNotNull()), asked), F.lit(False))
    else:
        hit = F.coalesce(F.size(F.array_except(asked, tags)) == 0, F.lit(False))
    return (~bare & hit) if mode.endswith("strict") else (bare | hit)


@dataclass(frozen=True)
class Tagged:
    tags: tuple[str, ...]
    mode: str = "any_strict"


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def compile_groups(tags: Column, groups: list) -> Column:
    """A list of nested and/or/not groups, all of which must hold, as one two-valued predicate."""

    def one(g) -> Column:
        match g:
            case Tagged(wanted, mode):
                return tag_filter(tags, list(wanted), mode)
            case And(parts):
                out = F.lit(True)
                for p in parts:
                    out = out & one(p)
                return out
            case Or(parts):
                out = F.lit(False)
                for p in parts:
                    out = out | one(p)
                return out
            case Not(part):
                return ~one(part)
        raise ValueError(f"not a tag group: {g!r}")

    return one(And(tuple(groups)))


def visible(tags: Column, wanted: list[str] | None = None, mode: str = "any", groups: list | None = None) -> Column:
    """Tags and tag groups exclude each other."""
    if wanted and groups:
        raise ValueError("give tags or tag groups, not both")
    return compile_groups(tags, groups) if groups else tag_filter(tags, wanted, mode)
