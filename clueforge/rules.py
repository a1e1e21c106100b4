"""Rule packs: vocabulary and thresholds as data, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RulePack:
    """Terms by category, context lists and promotion rules of one domain."""

    categories: dict[str, tuple[str, ...]]
    secondary: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    defensive: tuple[str, ...] = ()
    guide: tuple[str, ...] = ()
    solicitation: tuple[str, ...] = ()
    negation: tuple[str, ...] = ()
    promotion: tuple[dict, ...] = ()

    def hits(self, text: Column) -> dict[str, Column]:
        """The number of a category's terms that occur, by category."""
        low = F.lower(text)
        return {c: sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0)) for c, terms in self.categories.items()}

    def any_of(self, text: Column, terms: tuple[str, ...]) -> Column:
        low = F.lower(text)
        found = F.lit(False)
        for term in terms:
            found = found | low.contains(term.lower())
        return found


#: A pack whose terms occur in invented Latin-script prose.
FIXTURE = RulePack(
    categories={
        "credential": ("password", "token", "akia"),
        "contact": ("@mail", "+1 (", "example.com"),
        "insult": ("stupid", "idiot", "hate"),
        "prose": ("the", "und", "que", "les"),
    },
    secondary={"credential": {"login": ("password",), "api": ("token", "akia")}, "contact": {"mail": ("@mail",), "phone": ("+1 (",)}},
    defensive=("license", "copyright", "permission"),
    guide=("tutorial", "how to"),
    solicitation=("password", "@mail"),
    negation=("not", "no", "pas", "nicht"),
    promotion=(
        {"name": "contact", "types": ("email", "phone"), "min_sources": 2, "min_traces": 2, "pass": "contact_cross_source", "fail": "contact_requires_two_sources"},
        {"name": "network", "types": ("ip", "domain"), "min_sources": 2, "min_traces": 2, "pass": "network_cross_source", "fail": "network_requires_two_sources"},
        {"name": "template", "types": ("template",), "min_sources": 1, "min_traces": 3, "pass": "template_repeated", "fail": "template_requires_three"},
    ),
)
