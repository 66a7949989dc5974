"""Parameters of extracts (D12, D13, SRC-11, SRC-12, EXT-5, EXT-6)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

BATCH_SIZE = "BatchSize"
DEFAULT_BATCH_SIZE = 1000


@dataclass(frozen=True)
class ExtractParameter:
    name: str
    value: Any
    category: str = "user"
    kind: type | None = None

    def __post_init__(self):
        object.__setattr__(self, "name", self.name.lstrip("@"))


def context(batch_size: int = DEFAULT_BATCH_SIZE, row: dict[str, Any] | None = None, user: list[ExtractParameter] | None = None) -> list[ExtractParameter]:
    """Batch size, then the upstream row's properties, then the user's parameters."""
    own = [ExtractParameter(BATCH_SIZE, batch_size, "system", int)]
    own += [ExtractParameter(k, v, "row", type(v)) for k, v in (row or {}).items()]
    return own + list(user or [])


def user_parameter(name: str, value: Any) -> ExtractParameter:
    if value is None:
        raise ValueError(f"parameter {name} needs a value")
    return ExtractParameter(name, value, "user", type(value))


def as_args(params: list[ExtractParameter]) -> dict[str, Any]:
    """By name; a later one replaces an earlier one."""
    return {p.name: p.value for p in params}


def get_value(params: list[ExtractParameter], name: str, default: Any = None) -> Any:
    """The first parameter of that name; the default if missing or null."""
    found = next((p for p in params if p.name.lower() == name.lstrip("@").lower()), None)
    return default if found is None or found.value is None else found.value


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|@(\w+)", re.S)


def to_markers(sql: str) -> tuple[str, set[str]]:
    """``@name`` outside literals and comments as ``:name``; and the names."""
    names: set[str] = set()

    def swap(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        names.add(m[1])
        return f":{m[1]}"

    return _TOKEN.sub(swap, sql), names


def fill_markers(sql: str, values: dict[str, Any], literal) -> str:
    """``@name`` outside literals and comments as the literal of its value, put in once."""
    by = {n.lower(): v for n, v in values.items()}
    return _TOKEN.sub(lambda m: m[0] if m[1] is None else literal(by[m[1].lower()]), sql)


_WORD = re.compile(_TOKEN.pattern.removesuffix("|@(\\w+)") + r"|@\w+|([A-Za-z_]\w*)", re.S)


def rename_views(sql: str, names: dict[str, str]) -> str:
    """Names of views outside literals and comments under other names."""
    by = {n.lower(): v for n, v in names.items()}
    return _WORD.sub(lambda m: by.get(m[1].lower(), m[0]) if m[1] else m[0], sql)
