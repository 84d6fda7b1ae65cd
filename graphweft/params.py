"""Validated parameters of the searches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class InvalidInput(ValueError):
    """A parameter is out of its range; carries the code of the tool surface."""

    code = "INVALID_INPUT"


@dataclass(frozen=True)
class Search:
    """A candidate search: query text, scope and size of the answer."""

    query: str
    graph_id: str | None = None
    graph_ids: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    top_k: int = 8
    terms: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if not self.query.strip():
            raise InvalidInput("the query is blank")
        if self.graph_id and self.graph_ids:
            raise InvalidInput("give one graph_id or several graph_ids, not both")
        if not 1 <= self.top_k <= 50:
            raise InvalidInput("top_k must lie between 1 and 50")
        object.__setattr__(self, "terms", tuple(re.findall(r"[a-zA-Z0-9_]+", self.query.lower())))

    @property
    def scope(self) -> tuple[str, ...]:
        """The graphs to search in; none means all."""
        return (self.graph_id,) if self.graph_id else self.graph_ids

    @property
    def distinct_terms(self) -> dict[str, int]:
        """Query terms in order of appearance with the number of times that each occurs."""
        out: dict[str, int] = {}
        for t in self.terms:
            out[t] = out.get(t, 0) + 1
        return out


@dataclass(frozen=True)
class Details:
    """A lookup of nodes by id and what to include."""

    node_ids: tuple[str, ...]
    relationships: bool = True
    docstring: bool = True
    skeleton: bool = True
    excerpt: bool = False

    def __post_init__(self):
        if not self.node_ids:
            raise InvalidInput("no node ids are given")
        if len(self.node_ids) > 100:
            raise InvalidInput("at most 100 node ids can be looked up at once")
