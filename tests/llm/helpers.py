"""Brute-force versions and fixtures."""

from __future__ import annotations

import re
import unicodedata

CONV = "id string, topic string, core_question string, category string, source string, messages array<struct<role: string, content: string>>, extra int"
PLAN = "id string, topic string, core_question string, category string, source string, turns array<string>, extra int"
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍‎‏⁠﻿"))
UNSPACED = "฀-໿぀-ヿ㐀-鿿"


def words(text):
    t = unicodedata.normalize("NFKC", text.translate(INVISIBLE)).lower()
    return re.findall(rf"[{UNSPACED}][̀-ͯัิ-ฺ็-๎]*|[^\W_{UNSPACED}]+", t)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edit_in(pattern, text):
    """Least edit distance of pattern against any part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def groups(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, k in edges:
        up[find(("i", i))] = find(("k", k))
    out = {}
    for i, _ in edges:
        out.setdefault(find(("i", i)), set()).add(i)
    return {frozenset(v) for v in out.values()}
