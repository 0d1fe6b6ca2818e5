"""Questions to plans: terms, intents, query type, views, weights. Pure Python on one question, on the driver.

The rules are tables: an intent is a set of words and phrases with a few conditions, a query type the first rule that
holds, and views and weights are looked up by type.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from sightloom import lexicons as L

WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")


def terms(question: str) -> frozenset[str]:
    """Words of three letters or more that either stop list lets through, and their forms without a plural s."""
    seen = [w for w in WORD.findall(question.lower()) if len(w) > 2]
    kept = {w for w in seen if w not in L.PLANNER_STOPWORDS}
    return frozenset(kept | {w[:-1] for w in kept if w.endswith("s") and len(w) > 4} | {w for w in seen if w not in L.STOPWORDS})


@dataclass(frozen=True)
class Asked:
    """A question in lower case, and its terms."""

    text: str
    terms: frozenset[str]

    def any(self, words: frozenset[str] | set[str]) -> bool:
        return not self.terms.isdisjoint(words)

    def says(self, phrases: tuple[str, ...]) -> bool:
        return any(p in self.text for p in phrases)

    def either(self, words: frozenset[str], phrases: tuple[str, ...]) -> bool:
        return self.any(words) or self.says(phrases)


_CONTEXT = L.INSTANCE_OBJECTS | L.INSTANCE_EVENTS | L.TRAJECTORY | L.STATE | L.EVENT | L.INSTANCE_REGIONS
_VISUAL = L.INSTANCE_OBJECTS | L.INSTANCE_EVENTS | L.TRAJECTORY | L.DIRECTIONS


def intents(q: Asked) -> dict[str, bool]:
    context = q.any(_CONTEXT)
    spatial = q.either(L.SPATIAL_TERMS, L.SPATIAL_PHRASES)
    order = q.either(L.ORDER_TERMS, L.ORDER_PHRASES)
    transition = q.either(L.TRANSITION_TERMS, L.TRANSITION_PHRASES)
    others = q.any({"another", "other", "multiple"})
    multi = q.either(L.MULTI_TERMS, L.MULTI_PHRASES) or spatial and others or order and (others or q.any({"several"}))
    acting = q.either(L.ACTING_TERMS, L.ACTING_PHRASES)
    return {
        "spatial_relation": spatial,
        "temporal_trajectory": q.either(L.PATH_TERMS | L.TRAJECTORY, L.PATH_PHRASES),
        "temporal_ordering": order,
        "temporal_interaction": (order or transition) and (multi or context or acting) or q.says(("before and after", "one after another")),
        "transition": transition,
        "multi_object_interaction": multi,
        "event_localization": q.either(L.PLACE_TERMS - {"where", "when"}, L.PLACE_PHRASES) or q.any({"where", "when"}) and context,
        "evidence_grounded": q.either(L.GROUNDED_TERMS, L.GROUNDED_PHRASES),
    }


def asks_for_summary(q: Asked) -> bool:
    return q.says(L.GLOBAL_PHRASES) or q.any({"summarize", "summary", "overview"}) and q.any({"whole", "overall", "general"})


def asks_for_chain(q: Asked) -> bool:
    """An object in a place at an event: what only a chain of visual evidence answers."""
    moved = q.says(("is moved", "was moved", "being moved", "gets moved", "got moved"))
    place = q.any(L.INSTANCE_SPATIAL) or q.says(("next to", "close to", "left of", "right of", "in front of"))
    anchored = moved or q.says(("when", "after", "before", "during")) or q.any(L.INSTANCE_EVENTS)
    happens = moved or q.any(L.INSTANCE_EVENTS | L.TRAJECTORY | L.DIRECTIONS)
    told = q.any(L.PLAN_ATTRIBUTES | L.INSTANCE_REGIONS) or "onto" in q.text or len(q.terms & L.INSTANCE_OBJECTS) >= 2
    return q.any(L.INSTANCE_OBJECTS) and place and anchored and happens and told


Rule = tuple[str, Callable[[Asked, dict[str, bool]], bool]]
#: The first that holds is the query type.
TYPES: tuple[Rule, ...] = (
    ("general_description", lambda q, i: asks_for_summary(q) and not any(i.values())),
    ("instance_spatial_temporal", lambda q, i: asks_for_chain(q)),
    ("temporal", lambda q, i: (i["temporal_interaction"] or i["temporal_ordering"] or i["transition"]) and (q.any(_VISUAL | L.EVENT | L.STATE) or i["temporal_trajectory"] or i["event_localization"])),
    ("instance_spatial_temporal", lambda q, i: i["spatial_relation"] and (i["temporal_trajectory"] or i["multi_object_interaction"] or q.any(_VISUAL))),
    ("interaction", lambda q, i: i["multi_object_interaction"]),
    ("trajectory", lambda q, i: i["temporal_trajectory"]),
    ("spatial_relation", lambda q, i: i["spatial_relation"]),
    ("event_localization", lambda q, i: i["event_localization"]),
    ("speech", lambda q, i: q.any(L.SPEECH)),
    ("state_change", lambda q, i: q.any(L.STATE)),
    ("before_after", lambda q, i: q.any(L.BEFORE_AFTER | L.TEMPORAL)),
    ("trajectory", lambda q, i: q.any(L.TRAJECTORY | L.DIRECTIONS)),
    ("interaction", lambda q, i: q.any(L.INTERACTION)),
    ("event", lambda q, i: q.any(L.EVENT | {"happen", "happening"}) or q.says(("event", "activity"))),
    ("general_description", lambda q, i: q.any(L.SCENE)),
    ("object_list", lambda q, i: q.any({"object", "objects", "visible"}) and q.says(("which", "what", "list"))),
    ("object_grounding", lambda q, i: q.any(L.OBJECT_QUERY_TERMS)),
    ("default", lambda q, i: True),
)


@dataclass(frozen=True)
class QueryPlan:
    query: str
    query_type: str
    required_views: tuple[str, ...]
    optional_views: tuple[str, ...]
    roles: tuple[str, ...]
    terms: tuple[str, ...]
    intents: dict[str, bool]
    weights: dict[str, float]
    visual_chain: bool
    constraints: dict[str, float] = field(default_factory=dict)

    @property
    def views(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.required_views, *self.optional_views)))

    @property
    def order(self) -> tuple[str, ...]:
        return tuple(v for v in L.VIEW_ORDER if v in self.views)


def plan(question: str, *, max_evidence: int = 18, token_budget: int = 12_000, visual_relations: bool = False) -> QueryPlan:
    q = Asked(question.lower(), terms(question))
    found = intents(q)
    kind = next(name for name, holds in TYPES if holds(q, found))
    summary_only = asks_for_summary(q) and not any(found[k] for k in ("spatial_relation", "temporal_trajectory", "multi_object_interaction", "event_localization"))
    chain = any(found.values()) and not summary_only
    required, optional, roles = L.VIEW_ROLES[kind]
    if chain and kind not in ("general_description", "speech"):
        required = (*L.VISUAL_VIEWS, *required)
        roles = ("attribute_grounding", "spatial_relation", "motion_evidence", "event_binding", *roles)
    once = lambda views: tuple(v for v in dict.fromkeys(views) if visual_relations or v != "visual_relation")
    weights = dict(zip(("scope", "target", "track", "event", "coverage"), L.VIEW_WEIGHTS.get(kind, L.VIEW_WEIGHTS["default"]), strict=True))
    if chain or kind == "instance_spatial_temporal":
        weights |= {v: 1.0 for v in L.VISUAL_VIEWS if visual_relations or v != "visual_relation" or kind == "instance_spatial_temporal"}
    limits = {"max_evidence": max_evidence, "token_budget": token_budget, "optional_score_threshold": 0.15, "max_evidence_chars": min(token_budget, 8000), "max_item_chars": 900, "max_segment_items": 6, "max_track_items": 3, "max_event_items": 3}
    return QueryPlan(question, kind, once(required), once(optional), tuple(dict.fromkeys(roles)), tuple(sorted(q.terms)), found, weights, chain, limits)
