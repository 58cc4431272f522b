"""Answers as JSON that fit into a response."""

from __future__ import annotations

import json

#: Bytes of a response (a fixed value).
MOST_BYTES = 800_000
NOTE = "\n\n⚠ Response truncated. Use limit/offset parameters to paginate."


def _size(value: object) -> int:
    return len(json.dumps(value, ensure_ascii=False).encode())


def _cut(text: str, most: int) -> str:
    return text if len(text.encode()) <= most else text.encode()[:most].decode("utf-8", "ignore") + NOTE


def fit(answer: object, most: int = MOST_BYTES) -> str:
    """The answer as indented JSON.  Where it is too long, lists of over half the room keep a quarter (ten at least) and say
    where the next page begins; what is still too long is cut between characters."""
    text = json.dumps(answer, ensure_ascii=False, indent=2)
    if len(text.encode()) <= most or not isinstance(answer, dict):
        return _cut(text, most)
    out: dict = {}
    for key, value in answer.items():
        out[key] = value
        if isinstance(value, list) and _size(value) > most // 2:
            n = min(len(value), max(len(value) // 4, 10))
            out[key] = value[:n]
            out[f"{key}_pagination"] = {"shown": n, "total": len(value), "next_offset": n, "hint": f"Use offset={n} and limit={n} to fetch the next page"}
    return _cut(json.dumps(out, ensure_ascii=False, indent=2), most)
