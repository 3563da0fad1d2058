"""Scoped ids run:scope:local and the name of totals."""

from __future__ import annotations

ALL_COMPANIES = "__ALL__"


def make_id(run: str, scope: str, local: object) -> str:
    parts = (run, scope, str(local))
    if any(not p or ":" in p for p in parts):
        raise ValueError(f"parts must be non-empty and hold no colon: {parts}")
    return ":".join(parts)


def parse_id(value: str) -> tuple[str, str, str]:
    parts = value.split(":")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"{value!r} is no scoped id")
    return parts[0], parts[1], parts[2]
