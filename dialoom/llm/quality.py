"""Problem 9: per-document text quality statistics.

Documents are cut into chunks of whole lines; a line longer than REACH counts as further lines marked as going on, so
that what is counted does not depend on the size of the chunks. A chunk is divided into fragments of paragraphs, which
give associative counts. Paragraphs inside a chunk are judged at once; those open at its ends carry the counts of their
fragments and are judged when these are summed. Sums go up a tree: fragment, paragraph, document. Ratios and the rule's
outcome come from the sums. All of it is built-in functions.

A line is structure when its form says so: list item, table row, log, code or markup, form or key, menu. What is left of a
paragraph is prose, or keywords or junk, by its share of symbols and of common words, or of particles in scripts without
spaces. A document is found when more than half of its visible characters are not prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.normalize import INVISIBLE, UNSPACED
from dialoom.llm.records import table
from dialoom.operators.scale import spread

#: Characters a chunk; and how far a line reaches before it is cut into segments, each judged as a line.
CHUNK, REACH = 8192, 2048
#: Most rows of common_words that are taken into an expression.
WORD_LIST = 20_000
#: Share of common words from which text with spaces is prose, of symbols from which text is junk, of letters below which it is.
COMMON, SYMBOLS, LETTERS = 0.1, 0.1, 0.5
#: Share of common words, of all languages, from which one need not ask whether one language alone has enough.
PLENTY = 0.2
#: The same for particles per character in scripts without spaces.
PARTICLES = 0.05
#: Paragraphs of fewer words are judged by how they end.
FEW = 6

# Frequent particles and pronouns of Chinese, Japanese and Thai, which have no list of common words.
PARTICLE = (
    "的|了|是|在|我|你|他|她|们|不|有|这|那|和|就|都|也|要|会|能|吗|呢|吧|没|说|为|什么|怎么|已经|可是|可以"
    "|は|が|を|に|で|と|も|の|から|まで|です|ます|した|して|ない|ません|だ|か|って"
    "|ที่|ได้|ไม่|แล้ว|คุณ|ฉัน|ของ|เป็น|และ|ว่า|จะ|ให้|กับ|มา|เมื่อ|นี้|ทำไม|อะไร|ถ้า|ไหม|หรือ|ช่วย|ก่อน|มี|ใน"
)
_LETTER = r"\p{L}\p{M}"
_SEP = r"[ \t]+(?:\||»|>|›|→|·|•|::)[ \t]+"
# Lines whose form is not that of running text. Each alternative is matched from the start of a line to its end; where its
# beginning could be of any length, it first looks whether the line has the character that it needs.
STRUCTURE = r"(?m)^(?:" + "|".join([
    r"[ \t]*\|.*",  # table row
    r"(?=[^\t\n]*+\t[^\t\n]*+\t).*",  # tab-separated
    r"(?=[^,\n]*+,[^,\n]*+,)(?:[^,\n]*(?:,[^\s\d,]|(?<!\d),(?=\d)|,(?=,))){2}[^\n]*", r"(?=[^;\n]*+;)(?:[^;\n]*;(?=\S)){2}[^\n]*",  # comma- and semicolon-separated
    r"[ \t]*[\[{][ \t]*[\"\[{][^\n]*[:,\]}][^\n]*", r"(?=[^\"\n]*+\")[^\n]*\"[\w$-]+\"[ \t]*:[ \t]*[\"\d\[{tfn-][^\n]*",  # JSON
    r"[^\n]*\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b[^\n]*[=:\[][^\n]*",  # log
    r"[ \t]*\d{9,13}[ \t][^\n]*", r"[ \t]*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*", r"(?=[^\n=]*+=)[^\n=]*\w=[^\s=]+[ \t]+[\w.]+=[^\s=]+[^\n]*",
    r"[ \t]*(?:def|class|import|from|return|elif|else|try|except|while|function|var|let|const|public|private|static|void|int)\b[^\n]*[:;({)}=][^\n]*",
    r"[ \t]*(?:if|for|while)\b[^\n]*(?:[=!<>]=|\bin\b|[<>(])[^\n]*[:{][^\n]*", r"[ \t]*(?://|/\*|#!|#include|\*/|--)[^\n]*",  # code
    r"[ \t]*[\w.\[\]]+[ \t]*[-+*/|&]?=[ \t]*[^\n]*", r"(?=[^{}\n]*+[{}])[^\n]*[{}][ \t]*", r"(?=[^;\n]*+;)(?=[^\n]*;[ \t]*$)[^\n]*[=()\[\]\"'][^\n]*", r"[ \t]*[\w.]+\([^\n]*\)[ \t;]*", r"[ \t]*</?[A-Za-z][^>\n]*>[^\n]*",
    r"[^\n]*(?:\.{4,}|_{3,}|\[[ \t_]+\])[^\n]*", r"[ \t]*(?:Q|A)\d+[).:]?[ \t][^\n]*",  # forms and answer keys
    r"[^\n.!?]{1,60}:[ \t]*[-+]?[\d.,]+[ \t]*%?[ \t]*", r"[^\n.!?:]{1,40}:[ \t]*(?:true|false|null|none|yes|no)[ \t]*",
    rf"(?![^\n]*«)(?:(?:(?!{_SEP})[^\n]){{1,90}}(?:{_SEP})){{2}}[^\n]*",  # menus and columns
    r"[^\n]*[A-Za-z0-9+/=_-]{40,}[^\n]*", r"(?:[0-9A-Fa-f]{2,}[ \t:]+){6}[^\n]*",  # encoded
]) + r")$\n?"
# A list item that is no full sentence; one alone in its paragraph may be a broken line of prose.
ITEM = (
    r"(?m)^[ \t]*(?:[-*•·▪◦+–]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])[ \t]+"
    r"(?=[^\n]*(?<![.!?。！？؟।…][\"”»’)]{0,1})[ \t]*(?:\n|$))[^\n]*$\n?"
)
SYMBOL = rf"[^{_LETTER}\p{{N}}\s\x{{a0}}.,!?'\"’‘“”„«»:;()¿¡…。，、！？；：「」『』（）؟،؛।\-–—\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}%$€£&/+*#]"
SPACED_WORD = rf"[{_LETTER}]+(?:['’\-][{_LETTER}]+){{0,9}}+"
PLAIN = rf"[{_LETTER}\p{{N}}\s\x{{a0}}.,!?'\"’“”:;()-]+"
BREAK = r"\n[ \t\r]*\n"
# Marks of a cut line: at the end of a segment, and at the beginning of the next, by itself or in the middle of a word.
CUT, ON, WITHIN = (chr(0xFDD0 + i) for i in range(3))
SENTENCE_END = rf"(?:(?<![.!?…؟।])[.!?…؟।]++[\"”»’)\]]*+(?=\s|$)|[。！？]+)"


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, piece, part, ends): pieces that together hold every character once, and the same with marks for counting.

    A part consists of whole lines or segments. ends tells which chunks of a document hold the end of a paragraph, null
    where there is one chunk only.
    """
    text = F.translate(F.coalesce("text", F.lit("")), INVISIBLE + CUT + ON + WITHIN, "")
    whole = text.endswith("\n")
    d = docs.select("doc_id", F.when(whole, text).otherwise(F.concat(text, F.lit("\n"))).alias("text"), whole.alias("whole"))
    begin = rf"(?:\A|(?<=\n)|\G)(?=[^\n]{{{REACH + 1}}})(?:[^\n]{{1,{REACH - 1}}}[ \t]|[^\n]{{{REACH}}})"
    cut_up = F.regexp_replace("text", begin, f"$0{CUT}\n{ON}")
    cut_up = F.regexp_replace(cut_up, rf"(?<=[{_LETTER}]{CUT}\n){ON}(?=[{_LETTER}])", WITHIN)
    d = d.withColumn("text", F.when(F.col("text").rlike(rf"(?:\A|\n)[^\n]{{{REACH + 1}}}"), cut_up).otherwise(F.col("text")))
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{0,{CHUNK - 1}}}\n|[^\n]*+\n"), F.lit(0))
    d = d.select("doc_id", "whole", F.when(F.length("text") <= CHUNK, F.array("text")).otherwise(parts).alias("parts"))
    ends = F.array_join(F.transform("parts", lambda p: F.when(F.concat(F.lit("\n"), p).rlike(BREAK), "1").otherwise("0")), "")
    d = d.withColumn("ends", F.when(F.size("parts") > 1, ends))
    # There is always a part; the outer form does not compute the parts once more to make sure.
    d = d.select("doc_id", "ends", "whole", F.size("parts").alias("k"), F.posexplode_outer("parts").alias("chunk", "part"))
    piece = F.translate(F.replace("part", F.lit(f"{CUT}\n"), F.lit("")), ON + WITHIN, "")
    added = ~F.col("whole") & (F.col("chunk") == F.col("k") - 1)
    return d.select("doc_id", "chunk", F.when(added, F.rtrim(piece, F.lit("\n"))).otherwise(piece).alias("piece"), "part", "ends")


def fragments(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, paragraph, p): fragments of paragraphs; paragraph is null where the whole of it is in p.

    Together the fragments hold every visible character of docs(doc_id, text) once.
    """
    d = chunks(docs).select("doc_id", "ends", "chunk", F.split(F.concat(F.lit("\n"), "part"), BREAK).alias("ps"))
    d = d.select("doc_id", "ends", "chunk", F.size("ps").alias("k"), F.posexplode_outer("ps").alias("n", "p"))
    # A chunk begins with the paragraph that begins behind the last chunk in which one ends.
    head = F.length(F.rtrim(F.left("ends", F.col("chunk")), F.lit("0")))
    paragraph = F.when(F.col("ends").isNotNull(), F.when(F.col("n") == 0, head).when(F.col("n") == F.col("k") - 1, F.col("chunk") + 1))
    return d.select("doc_id", "chunk", paragraph.alias("paragraph"), "p")


def _counts(x: Column, listed: list[str]) -> dict[str, Column]:
    """What is counted of a text; sums over texts of whole lines are the counts of all of them."""
    high = F.regexp_replace(x, r"[\x{0}-\x{dff}]+", "")  # empty for most texts
    of = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    low = F.regexp_replace(x, rf"[\x{{e00}}-\x{{faff}}&&[{UNSPACED}]]+", " ")
    plain = F.regexp_replace(x, PLAIN, "")
    said = F.split(F.lower(x), rf"[^{_LETTER}]+")
    some = lambda c: F.when(high != "", c).otherwise(0)
    return {
        "shown": of(x, r"[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+"),
        "letters": of(x, rf"[^{_LETTER}]+"),
        "words": F.regexp_count(F.when(high != "", low).otherwise(x), F.lit(SPACED_WORD)),
        "unspaced": some(of(high, f"[^{UNSPACED}]+")),
        "unspaced_letters": some(of(high, rf"[^{_LETTER}&&[{UNSPACED}]]+")),
        "plain": F.length(plain),
        "symbols": F.regexp_count(plain, F.lit(SYMBOL)),
        "particles": some(F.regexp_count(high, F.lit(PARTICLE))),
        "stops": some(F.regexp_count(high, F.lit("[。！？…]+"))),
        "common": F.filter(said, lambda w: w.isin(listed)),
    }


def statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """A row of counts, ratios and outcome for each row of docs(doc_id, text); common: (lang, word).

    Null and blank texts count 0 everywhere and are not found. Texts of any length are measured whole. Rows of one doc_id
    are summed as one document. A line over REACH characters counts once in n_lines, its form is judged by segments. The
    word list, one table of whole words, is bounded by WORD_LIST.
    """
    rows = common.select("lang", F.lower("word").alias("word")).filter("word <> ''").distinct().limit(WORD_LIST + 1).collect()
    if len(rows) > WORD_LIST:
        raise ValueError("the list of common words is too long for an expression")
    listed = sorted({r["word"] for r in rows})
    by_lang = [[r["word"] for r in rows if r["lang"] == lang] for lang in sorted({r["lang"] or "" for r in rows})]
    col, zero = F.col, F.lit(0)
    f = fragments(docs)
    f = f.withColumn("q", F.when(col("p").contains(CUT) | col("p").contains(ON) | col("p").contains(WITHIN), F.translate("p", CUT + ON + WITHIN, "")).otherwise(col("p")))
    f = f.withColumn("u", F.regexp_replace("q", STRUCTURE, "")).withColumn("n_items", F.regexp_count("u", F.lit(ITEM)))
    f = f.withColumn("rest", F.when(col("n_items") > 0, F.regexp_replace("u", ITEM, "")).otherwise(col("u")))
    f = f.withColumn("items", F.when(col("n_items") > 0, F.array_join(F.regexp_extract_all("u", F.lit(ITEM), F.lit(0)), "")).otherwise(""))
    names = ["shown", "letters", "words", "unspaced", "plain", "symbols", "particles", "stops"]
    whole, rest, items = (_counts(col(c), listed) for c in ("q", "rest", "items"))
    f = f.select("*", *[v.alias(f"q_{k}") for k, v in whole.items()])
    # Where nothing is structure the rest is the whole.
    same = lambda k: F.when(col("rest") == col("q"), col(f"q_{k}")).otherwise(rest[k]).alias(f"r_{k}")
    few_items = lambda k: F.when(col("items") != "", items[k]).otherwise(F.array().cast("array<string>") if k == "common" else zero).alias(f"i_{k}")
    f = f.select("*", *[same(k) for k in [*names, "common"]], *[few_items(k) for k in [*names, "common"]])
    cut_words = F.when(col("p").contains(WITHIN), F.regexp_count("p", F.lit(WITHIN))).otherwise(zero)
    hits = [*names, "listed", *[f"in{i}" for i in range(len(by_lang))]]
    of_list = lambda c, ws: F.size(F.filter(c, lambda w: w.isin(ws)))
    heard = lambda c: {"listed": F.size(c)} | {f"in{i}": of_list(c, ws) for i, ws in enumerate(by_lang)}
    spoken = {s: {k: col(f"{s}_{k}") for k in names} | heard(col(f"{s}_common")) for s in "ri"}
    # Asked only of short paragraphs, and of fragments that may be the end of one.
    ended = (col("paragraph").isNotNull() | (col("r_words") < FEW)) & col("p").rlike(rf"{SENTENCE_END}\s*$")
    f = f.select(
        "doc_id", "chunk", "paragraph", "n_items", col("q_shown").alias("shown"), (col("q_words") - cut_words).alias("words"),
        (col("q_letters") - col("q_unspaced_letters")).alias("word_letters"), col("q_unspaced").alias("unspaced"), col("q_plain").alias("symbols"),
        F.size("q_common").alias("common"), F.regexp_count("p", F.lit(rf"(?m)^(?![{ON}{WITHIN}]).*\S.*$")).alias("lines"),
        F.regexp_count("p", F.lit(rf"(?m){SENTENCE_END}[ \t]*$")).alias("ended_lines"), ended.alias("ended"),
        *[v.alias(f"{s}_{k}") for s in "ri" for k, v in spoken[s].items()],
    )
    figures = ["shown", "words", "word_letters", "unspaced", "symbols", "common", "lines", "ended_lines"]

    def judged(ended: Column) -> dict[str, Column]:
        """Visible characters of prose and of structure; one item alone in its paragraph is no list."""
        t = {k: col(f"r_{k}") + F.when(col("n_items") <= 1, col(f"i_{k}")).otherwise(0) for k in hits}
        best = F.greatest(zero, zero, *[t[f"in{i}"] for i in range(len(by_lang))])
        # Meaningless words hit short words of many languages; prose has its common words from one.
        spaced = (best >= COMMON * t["words"]) | (t["listed"] >= PLENTY * t["words"])
        few = (t["words"] < FEW) & (ended | (t["listed"] > 0))
        unspaced = (t["particles"] >= PARTICLES * t["unspaced"]) | (t["stops"] * 60 >= t["unspaced"])
        prose = (
            (t["letters"] >= LETTERS * t["shown"]) & (t["symbols"] <= SYMBOLS * t["shown"])
            & F.when(t["unspaced"] * 2 >= t["letters"], unspaced).otherwise(spaced | few)
        )
        return {"prose_shown": F.when(prose, t["shown"]).otherwise(0), "structure_shown": col("shown") - t["shown"]}

    closed = col("paragraph").isNull()
    # Of paragraphs within a chunk only the outcome is kept, so a chunk comes down to one row and those of its open ends.
    f = f.withColumns({k: F.when(closed, v).otherwise(0) for k, v in judged(col("ended")).items()})
    raw = ["n_items", *[f"{s}_{k}" for s in "ri" for k in hits]]
    last = F.max(F.when(~closed & (col("shown") > 0), col("chunk").cast("bigint") * 2 + col("ended").cast("int")))
    g = f.groupBy("doc_id", "paragraph").agg(
        *[F.sum(c).alias(c) for c in [*figures, "prose_shown", "structure_shown"]],
        *[F.sum(F.when(~closed, col(c)).otherwise(0)).alias(c) for c in raw], last.alias("last"),
    )
    g = g.withColumns({k: F.when(closed, col(k)).otherwise(v) for k, v in judged(F.coalesce(F.pmod("last", F.lit(2)) == 1, F.lit(False))).items()})
    sums = g.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in [*figures, "prose_shown", "structure_shown"]])
    ratio = lambda a, b: F.when(col(b) > 0, col(a) / col(b))
    return sums.select(
        "doc_id", col("words").alias("n_words"), col("unspaced").alias("n_unspaced"), col("lines").alias("n_lines"), col("shown").alias("n_shown"),
        ratio("word_letters", "words").alias("mean_word_length"), ratio("symbols", "shown").alias("symbol_ratio"),
        ratio("ended_lines", "lines").alias("ended_line_ratio"), ratio("common", "words").alias("common_word_ratio"),
        ratio("structure_shown", "shown").alias("structure_ratio"), ratio("prose_shown", "shown").alias("prose_ratio"),
        F.coalesce(ratio("prose_shown", "shown") < 0.5, F.lit(False)).alias("not_prose"),
    )


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return statistics(docs, table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose text is not running prose."""
    return p9_quality(spark, sf_dir).filter("not_prose").select("doc_id")
