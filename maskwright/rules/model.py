"""Shapes of the three rule families.

A rule is plain driver-side data.  Plans are built from rules as literal
column expressions, so a rule that is left out costs nothing at run time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Flags put in front of every pattern: multi-line anchors, dot matches all,
# only "\n" ends a line, and Unicode classes for \w \d \s \b.
FLAGS = "(?msdU)"


@dataclass(frozen=True)
class SpanRule:
    """One pattern that yields spans.

    ``pct`` is the score in hundredths.  ``needs`` are literals of which at
    least one is part of every match, ``digits`` is the shortest run of digits in
    any match: cheap tests before the pattern runs.  ``first`` is a class that the first
    character of every match belongs to; it is looked at before borders are.
    ``group`` is the masked capture group and ``tail`` the number of characters
    of the match after that group.
    """

    entity: str
    rule: str
    regex: str
    pct: int
    label: str = ""
    context: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    needs_folded: tuple[str, ...] = ()
    digits: int = 0
    first: str = ""
    group: int = 0
    tail: int = 0
    description: str = ""
    enabled: bool = True

    def __post_init__(self):
        check_pattern(self.regex)
        if not 0 <= self.pct <= 100:
            raise ValueError(f"rule {self.rule}: score must be within 0 and 100")
        if not self.label:
            object.__setattr__(self, "label", self.entity)
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.label):
            raise ValueError(f"rule {self.rule}: a label is letters, digits and underscores: {self.label}")

    @property
    def pattern(self) -> str:
        return FLAGS + (f"(?={self.first})(?:{self.regex})" if self.first else self.regex)

    def ignoring_case(self) -> "SpanRule":
        return replace(self, regex="(?i)" + self.regex, first="", needs=(), needs_folded=tuple(n.lower() for n in self.needs) or self.needs_folded)


@dataclass(frozen=True)
class CodeRule:
    """One vulnerability pattern with its report texts."""

    rule_id: str
    title: str
    description: str
    severity: str
    regex: str
    cwe: str = ""
    advice: str = ""
    languages: tuple[str, ...] = ("python", "js", "ts", "any")
    needs: tuple[str, ...] = ()
    needs_folded: tuple[str, ...] = ()

    def __post_init__(self):
        check_pattern(self.regex)
        if self.severity not in SEVERITY_RANK:
            raise ValueError(f"rule {self.rule_id}: unknown severity {self.severity}")

    @property
    def pattern(self) -> str:
        return FLAGS + self.regex

    def applies_to(self, ext: str) -> bool:
        return "any" in self.languages or ext in self.languages


SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def check_pattern(regex: str) -> None:
    """Reject patterns which match the empty string: they have no span to mask."""
    try:
        compiled = re.compile(regex)
    except re.error:
        return  # syntax only the JVM knows; Spark checks it
    if compiled.match(""):
        raise ValueError(f"pattern matches the empty string: {regex}")
