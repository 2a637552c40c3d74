"""Text normalisation and tokenisation as Column expressions.

Unicode composition has no built-in Spark function, so it is the one step that may visit Python. It does so only for
rows that hold a character whose compatibility form differs, which a JVM regex decides; all other rows pass a null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that show nothing: soft hyphen, zero-width and bidirectional controls, byte-order mark.
INVISIBLE = "­​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
# Each part begins with a plain range, so that a character of the other part fails at once.
WORD = (
    rf"[\x{{e00}}-\x{{faff}}&&[{UNSPACED}]&&[\p{{L}}\p{{N}}]]\p{{M}}*"
    rf"|[[\x{{0}}-\x{{dff}}&&[\p{{L}}\p{{N}}\p{{M}}]][\x{{e00}}-\x{{10ffff}}&&[^{UNSPACED}]&&[\p{{L}}\p{{N}}\p{{M}}]]]+"
)
WORD_CHAR = r"\p{L}\p{N}\p{M}"


# Code point ranges (hexadecimal) in which compatibility composition changes letters, digits or marks, or
# joins a mark to the letter before it. A little too wide does no harm: the rows are only looked at once more.
COMPOSED = (
    "AA B2-B3 B5 B9-BA BC-BE 132-133 13F-140 149 17F 1C4-1CC 1F1-1F3 2B0-2B8 2E0-2E4 300-36F 37A 384-385 3D0-3D6 3F0-3F9 587 "
    "653-655 675-678 93C 958-95F 9BC 9BE 9D7 9DC-9DF A33-A36 A3C A59-A5E B3C B3E B56-B57 B5C-B5D BBE BD7 C56 CC2 CD5-CD6 D3E "
    "D57 DCA DCF-DDF E33 EB3 EDC-EDD F00-FFF 102E 10FC 1100-11FF 1B35 1D2C-1DBF 1E9A-1E9B 1F71-1FFF 2070-209C 2100-218F "
    "2460-24FF 2C7C-2C7D 2E9F-2FDF 3036-303A 3099-309A 309F 30FF 3131-318E 3192-33FF A69C-A69D A770 2D6F A7F2-A7F9 AB5C-AB69 "
    "F900-FDFF FE70-FEFC FF10-FFDC 10780-107BA 11099-11938 1D15E-1D1C0 1D400-1D7FF 1EE00-1EEBB 1F100-1F190 2F800-2FA1D"
)


def composed_class() -> str:
    """A Java character class of what composition may change; the first operand lets ASCII fail at once."""
    hexes = (r.split("-") for r in COMPOSED.split())
    return r"[\x{80}-\x{10FFFF}&&[" + "".join("-".join(f"\\x{{{x}}}" for x in r) for r in hexes) + "]]"


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFKC form; the Python step sees only the rows that need it."""
    need = F.when(text.rlike(composed_class()), text)
    return F.coalesce(_compose(need), text)


def visible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def words(text: Column, compose: bool = True) -> Column:
    """Array of lower-case words; in scripts without spaces every character is a word. Null text gives null."""
    t = visible(text)
    return F.regexp_extract_all(F.lower(composed(t) if compose else t), F.lit(WORD), F.lit(0))


def match_key(text: Column) -> Column:
    """The text without case, spacing, punctuation and Unicode form; null when nothing is left."""
    t = F.regexp_replace(F.lower(composed(visible(text))), rf"[^{WORD_CHAR}]+", "")
    return F.when(t != "", t)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; inside a lambda an expression would be computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def runs(hashes: Column, k: int) -> Column:
    """64-bit hashes of every run of k hashes, in order; empty when there are fewer. The column is read often, so bind it first."""
    n = F.size(hashes) - k + 1
    one = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)])
    every = F.transform(F.slice(hashes, F.lit(1), F.greatest(n, F.lit(1))), one)
    return F.when((n > 0) & (F.size(hashes) > 0), every).otherwise(F.array().cast("array<bigint>"))


def grams(tokens: Column, k: int) -> Column:
    """The same of every run of k tokens; tokens are hashed once each."""
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: runs(h, k))
