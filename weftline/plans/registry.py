"""Strategies by category and name, and a configuration that picks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

CATEGORIES = ("retrieval", "graph_retrieval", "fusion", "reranking", "causal", "query_rewriting")
_STRATEGIES: dict[str, dict[str, Callable]] = {c: {} for c in CATEGORIES}


def register(category: str, name: str) -> Callable[[Callable], Callable]:
    if category not in _STRATEGIES:
        raise ValueError(f"unknown category {category!r}")

    def add(f: Callable) -> Callable:
        _STRATEGIES[category][name] = f
        return f

    return add


def get(category: str, name: str) -> Callable:
    if category not in _STRATEGIES:
        raise ValueError(f"unknown category {category!r}")
    try:
        return _STRATEGIES[category][name]
    except KeyError:
        raise ValueError(f"no {category} strategy {name!r}; there are {sorted(_STRATEGIES[category])}") from None


def names(category: str) -> list[str]:
    return sorted(_STRATEGIES[category])


@dataclass(frozen=True)
class SearchConfig:
    retrieval: str = "semantic_bm25"
    graph_retrieval: str = "link_expansion"
    fusion: str = "rrf"
    reranking: str = "passthrough"
    causal: str = "memory_links"
    query_rewriting: str = "noop"

    def override(self, **changes: str) -> SearchConfig:
        for category, name in changes.items():
            get(category, name)
        return replace(self, **changes)
