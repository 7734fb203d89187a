"""Name rules evaluated on the schema only (no data is touched)."""
from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class NameRule:
    """Which columns may be keys and which key names look alike.

    ``default`` follows the behaviour we match: a name is key-like when it
    contains ``id``; two names look alike when, lower-cased and without
    underscores, one contains the other.  ``star`` suits TPC-style schemas:
    key-like names end in ``key`` and a one-word table prefix (``l_``) is
    dropped before comparing.
    """

    key_suffixes: tuple[str, ...] = ()
    key_substring: str | None = "id"
    strip_prefix: str | None = None

    def is_key_like(self, column: str) -> bool:
        low = column.lower()
        if self.key_substring is not None and self.key_substring in low:
            return True
        return bool(self.key_suffixes) and low.endswith(self.key_suffixes)

    def normalize(self, column: str) -> str:
        low = column.lower()
        if self.strip_prefix:
            low = re.sub(self.strip_prefix, "", low, count=1)
        return low.replace("_", "")

    def similar(self, a: str, b: str) -> bool:
        na, nb = self.normalize(a), self.normalize(b)
        return na == nb or na in nb or nb in na


DEFAULT_NAME_RULE = NameRule()
STAR_NAME_RULE = NameRule(key_suffixes=("key",), key_substring=None, strip_prefix=r"^[a-z]+_")

NAME_RULES = {"default": DEFAULT_NAME_RULE, "star": STAR_NAME_RULE}


def name_rule(rule: "str | NameRule") -> NameRule:
    return NAME_RULES[rule] if isinstance(rule, str) else rule


def entity_name(name: str) -> str:
    """Table name to a display name: underscores to spaces, title case."""
    return name.replace("_", " ").title()
