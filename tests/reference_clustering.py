"""Brute-force leader clustering in plain Python, for parity tests on small tables."""

from __future__ import annotations

import re

from briefloom.functions.text import STOPWORDS

WS = r"[\s   -     　﻿]"


def tokens(s: str) -> set[str]:
    import regex

    words = re.split(f"{WS}+", regex.sub(r"[^\p{L}\p{N}\s]", " ", s.lower()))
    return {w for w in words if len(w) > 1 and w not in STOPWORDS}


def trigrams(s: str) -> set[str]:
    s = re.sub(f"{WS}+", "", s.lower())
    return {s[i : i + 3] for i in range(len(s) - 2)}


def jaccard(a: set, b: set) -> float:
    if not a or not b:
        return 0.0
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def leaders(rows: list[dict], hours: float = 72, title: float = 0.33, strong: float = 0.55, snippet: float = 0.65) -> dict[int, int]:
    """ord -> leader, taking rows in ord order; rows have ord, title, snippet and ts (or None)."""
    heads: list[tuple] = []
    out = {}
    for r in sorted(rows, key=lambda x: x["ord"]):
        long = len(r["snippet"]) > 80
        f = (
            r["ord"], tokens(r["title"]), trigrams(r["title"]),
            tokens(r["snippet"]) if long else set(), trigrams(r["snippet"]) if long else set(), r["ts"],
        )
        for h in heads:
            near = f[5] is None or h[5] is None or abs((f[5] - h[5]).total_seconds()) <= hours * 3600
            t = max(jaccard(f[1], h[1]), jaccard(f[2], h[2]))
            if t >= strong or (t >= title and near) or max(jaccard(f[3], h[3]), jaccard(f[4], h[4])) >= snippet:
                out[f[0]] = h[0]
                break
        else:
            heads.append(f)
            out[f[0]] = f[0]
    return out
