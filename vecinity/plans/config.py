"""Job settings from `key=value` files."""

from __future__ import annotations


def parse_config(text: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """Settings of a file's text; `#` starts a comment line; a missing required key is an error."""
    lines = [line.strip() for line in text.splitlines()]
    out = dict(map(str.strip, line.split("=", 1)) for line in lines if "=" in line and not line.startswith("#"))
    missing = [k for k in required if k not in out]
    if missing:
        raise KeyError(f"missing settings: {', '.join(missing)}")
    return out
