"""The text judge's rules as Column expressions: masking, segments, terminator rule, answer matching, verdict parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.normalize import let

# Fixed values of the rule: the mask, the terminators, abbreviations and titles, and what may trail without being said.
MASK = "‧"
TERMINATORS = ".!?…！？。؟"
QUESTION = "?？؟"
ABBREVIATIONS = ("e.g", "i.e", "vs", "etc", "cf", "al", "approx")
TITLES = ("mr", "mrs", "ms", "dr", "prof")
TRAILING = "[\\s\"'”’)\\]*_`~#>-]*"
# What holds terminators that end nothing. Titles do so before a letter of either case.
URL = r"(?U)https?://\S+"
ACRONYM = r"(?U)\b(?:[A-Za-z]\.){2,}"
INITIALS = r"(?U)\b(?:[A-Z]\.\s+)+[A-Z]\.(?=\s+[A-Z][a-z])"
LIST_NUMBER = r"(?Umd)^\s*\d+(?:\.\d+)*\.(?=\s)"
DECIMAL = r"(?U)(?<=\d)\.(?=\d)"
_ON, _OFF = chr(0xE0FE), chr(0xE0FF)


def py_strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm(s: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def _inside(text: Column, pattern: str, chars: str) -> Column:
    """Masks the given characters within each match, and only there."""
    hidden = lambda p: F.translate(F.substring_index(p, _OFF, 1), chars, MASK * len(chars))
    one = lambda p, i: F.when(i == 0, p).otherwise(F.concat(hidden(p), F.substring_index(p, _OFF, -1)))
    parts = lambda t: F.split(F.regexp_replace(t, pattern, f"{_ON}$0{_OFF}"), _ON)
    return let(text, lambda t: F.when(t.rlike(pattern), F.array_join(F.transform(parts(t), one), "")).otherwise(t))


def masked(text: Column) -> Column:
    """Terminators that end nothing, masked: in URLs, acronyms, initials, list numbers, decimals, abbreviations, titles."""
    url = let(text, lambda t: F.when(t.contains("://"), _inside(t, URL, TERMINATORS)).otherwise(t))
    return let(url, lambda t: F.when(t.contains("."), _dots(t)).otherwise(t))


def _dots(t: Column) -> Column:
    for pattern in (ACRONYM, INITIALS, LIST_NUMBER):
        t = _inside(t, pattern, ".")
    t = F.regexp_replace(t, DECIMAL, MASK)
    for a in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"(?iU)\b{a.replace('.', '[.]')}\.", a.replace(".", MASK) + MASK)
    for a in TITLES:
        t = F.regexp_replace(t, rf"(?iU)\b{a}\.(?=\s+[A-Z])", a + MASK)
    return t


def has_content(s: Column) -> Column:
    return s.rlike(r"[\p{L}\p{N}]")


def segments(text: Column) -> Column:
    """Array of (seg, term): the masked text's segments and the run of terminators that closes each; blank lines give none."""
    line_parts = lambda ln: F.concat(
        F.regexp_extract_all(ln, F.lit(f"[^{TERMINATORS}]*[{TERMINATORS}]+"), F.lit(0)),
        F.filter(F.array(F.regexp_extract(ln, f"(?<![^{TERMINATORS}])[^{TERMINATORS}]*$", 0)), lambda s: ~s.rlike(f"(?U)^{TRAILING}$")),
    )
    lines = F.filter(F.split(masked(py_strip(text)), "\n"), lambda ln: ln.rlike(r"(?U)\S"))
    one = lambda s: F.struct(
        py_strip(F.regexp_replace(s, f"[{TERMINATORS}]+$", "")).alias("seg"), F.regexp_extract(s, f"[{TERMINATORS}]+$", 0).alias("term")
    )
    return F.transform(F.flatten(F.transform(lines, line_parts)), one)


def violations(text: Column, allowed: str = QUESTION) -> Column:
    """What breaks the rule that everything said ends with an allowed terminator; blank text is one violation."""
    bad = F.filter(segments(text), lambda s: has_content(s["seg"]) & ((s["term"] == "") | ~F.right(s["term"], F.lit(1)).isin(*allowed)))
    said = lambda s: F.when(s["term"] == "", F.concat(F.left(s["seg"], F.lit(120)), F.lit(" <no terminator>"))).otherwise(
        F.left(F.concat(s["seg"], s["term"]), F.lit(120))
    )
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), F.transform(bad, said)).otherwise(F.array(F.lit("<empty response>")))


def literal(s: Column) -> Column:
    """The string as a pattern that matches itself."""
    return F.regexp_replace(s, r"([^\p{L}\p{N}\s])", r"\\$1")


def string_hit(text: Column, answers: Column) -> Column:
    """The first answer, in array order, that stands in the text between ASCII word boundaries, in any case; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda a: (py_strip(a) != "") & F.regexp_like(
        low, F.concat(F.lit("(?<![a-z0-9])"), literal(F.lower(py_strip(a))), F.lit("(?![a-z0-9])"))
    )
    return let(F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: F.coalesce(hit(a), F.lit(False))), lambda x: F.get(x, F.lit(0)))


def weak(answer: Column) -> Column:
    """Too short or numeric to prove anything by itself."""
    a = py_strip(answer)
    return a.rlike(r"^\p{Nd}+$") | (F.char_length(a) < 4)


def parsed_verdict(reply: Column) -> Column:
    """true, false, or null for a reply that is no verdict: JSON with a boolean `leak`, fenced or with text around it."""
    body = F.regexp_replace(py_strip(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")
    body = F.when(body.contains("{"), F.substring_index(F.concat(F.lit("{"), F.regexp_extract(body, r"(?s)\{(.*)$", 1)), "\u0000", 1))
    doc = F.coalesce(F.from_json(body, "leak string"), F.from_json(F.concat(F.regexp_extract(body, r"(?s)^(\{[^{}]*\})", 1)), "leak string"))
    value = F.lower(doc["leak"])
    return F.when(value == "true", True).when(value == "false", False)


def parsed_array(reply: Column) -> Column:
    """The JSON array of strings in a reply, fenced or with text before it; null for a reply that holds none."""
    body = F.regexp_replace(py_strip(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(F.regexp_extract(body, r"(?s)\[.*$", 0), "array<string>")


def json_text(s: Column) -> Column:
    """The string as JSON with non-ASCII characters kept and control characters in lower-case hexadecimal."""
    j = F.regexp_replace(F.to_json(F.array(s)), r"(?s)^\[|\]$", "")
    fixed = j
    for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{c:04X}", rf"$1\\u{c:04x}")
    return F.when(j.rlike(r"\\u00[01][A-F]"), fixed).otherwise(j)


def json_list(items: Column) -> Column:
    """An array of strings as a JSON list with ", " between its members."""
    one = lambda x: F.when(x.isNull(), "null").otherwise(json_text(x))
    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))


def answer_text(summary: Column, answers: Column) -> Column:
    """What counts as the answer: the summary, or else the expected answers, joined; empty if there is neither."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.array_join(F.coalesce(answers, F.array().cast("array<string>")), ", "))


def verdict_key(question: Column, answer: Column, reply: Column) -> Column:
    """The key under which a verdict is kept: SHA-256 of the JSON list of question, answer and reply."""
    return F.sha2(json_list(F.array(question, answer, reply)), 256)


def sha_prefix(s: Column, n: int) -> Column:
    return F.left(F.sha2(s, 256), F.lit(n))


def chat_text(messages: Column) -> Column:
    """Messages as one text with role markers."""
    one = lambda m: F.concat(
        F.lit("<|im_start|>"), F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")
    )
    return F.array_join(F.transform(messages, one), "")
