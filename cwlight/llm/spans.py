"""What the span-finding operators share: kinds in order, digests, redaction."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]  # start, end (exclusive), kind; code points


def listed(spans: list[Span], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then by the kind's place in ``kinds``, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def union(spans: list[Span]) -> list[Span]:
    """Overlapping spans joined into one, under the kind of the first."""
    out: list[list] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, k])
    return [tuple(x) for x in out]


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, k in union(spans):
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
