"""Pointers of a request and the resolution of tags, numbers and hashes against them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from blocklens.plans.errors import invalid_params

TAGS = ("earliest", "finalized", "safe", "latest", "pending")


@dataclass(frozen=True)
class Pointers:
    """archived <= finalized <= safe <= latest; earliest is the first block of the archive."""

    earliest: int
    archived: int
    finalized: int
    safe: int
    latest: int

    @classmethod
    def of(cls, earliest: int, archived: int, finalized: int | None, safe: int | None, latest: int) -> Pointers:
        """Pointers clamped to at least the archived block and at most the head."""
        latest = max(latest, archived)
        clamp = lambda x: min(max(archived if x is None else x, archived), latest)
        return cls(earliest, archived, clamp(finalized), clamp(safe), latest)

    def number(self, ref: object) -> int:
        """Block number of a tag, a hex quantity or an object with blockNumber."""
        if isinstance(ref, dict) and "blockNumber" in ref:
            ref = ref["blockNumber"]
        if ref is None:
            return self.latest
        if isinstance(ref, str):
            if ref in TAGS:
                return self.latest if ref == "pending" else getattr(self, ref)
            if re.fullmatch(r"0[xX][0-9a-fA-F]{1,14}", ref):
                return int(ref, 16)
        raise invalid_params("a block is a tag, a hex number or an object")
