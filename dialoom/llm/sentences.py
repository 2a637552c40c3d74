"""Problem 4: sentence boundaries across languages and scripts, in SQL expressions only.

What only looks like a sentence end is masked, character by character, with private-use placeholders: URLs, quotations and
brackets, decimals, list numbers, initials, abbreviations, dots before a word inside a sentence. Then markers are set after
the terminators of each script, the text is split at them, and the offsets, which masking kept, restore the original text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.normalize import UNSPACED, let
from dialoom.llm.records import table
from dialoom.operators.scale import spread

TERMINATORS = ".!?…。！？؟।॥．｡"
PLACEHOLDERS = "".join(chr(0xE001 + i) for i in range(len(TERMINATORS)))
DOT = PLACEHOLDERS[0]
OPEN, SHUT, END = chr(0xE0FE), chr(0xE0FF), chr(0xE0F0)
BLANK = r" \t\x0b\x0c\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
GAP, INK = f"[{BLANK}]", rf"[^{BLANK}\r\n\x{{2028}}\x{{2029}}]"  # space that is no line break; what shows
CLOSERS = r"""["'”’»」』)\]）】›*_~`]"""
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{FE0F}\x{200D}]"
TAIL = rf"{CLOSERS}*+(?:{GAP}*+{EMOJI}++)*+"

# Abbreviations whose dot never ends a sentence when anything follows on the line.
ALWAYS = (
    "e.g i.e vs cf viz approx incl excl dr mr mrs ms prof mme mlle sr sra srta dra dres bzw evtl ggf vgl inkl zzgl bspw sog "
    "ej ул проф стр рис им см д-р д डॉ डा प्रो श्री د أ et.al al fig figs pág págs núm"
).split()
# Those that hold only before a number.
BEFORE_NUMBER = "p pp s no nr fig art abb kap núm pág cap vol ch стр с т approx n".split()
# Titles that hold only before a capital.
BEFORE_CAPITAL = "St Gen Col Rev Hon Capt Lt Sgt Mt Fr".split()
# Those that may end a sentence, and do so before a capital.
MAY_END = "a.m p.m etc usw тыс г гг руб коп млн млрд др inc ltd co corp jr bros u.s u.k".split()
# Words with which a sentence goes on after one of these, in text written without capitals or all in them.
GOES_ON = "and or at be the is was were in on when pour und y et for to from with as that which of than i.e e.g".split()
# Month names behind a German ordinal.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()

# The first character is looked at before the alternatives.
_SPANS = r"(?=[hw\"“„«‹「『(（\[【])(?:" + "|".join([
    r"(?:https?://|www\.)[^\s\x{3040}-\x{9fff}\x{ff00}-\x{ffef}]*[^\s\x{3040}-\x{9fff}\x{ff00}-\x{ffef}.!?,;:'\"”»’)\]]",
    r"(?<!\d)\"[^\"\n]*\"", "“[^”\n]*”", "„[^“”\n]*[“”]", "«[^»\n]*»", "‹[^›\n]*›", "「[^」\n]*」", "『[^』\n]*』",
    r"\([^()\n]*\)", "（[^（）\n]*）", r"\[[^\[\]\n]*\]", "【[^】\n]*】",
]) + ")"
_MAY_SPAN = r"[\"“„«‹「『(（\[【]"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ALONE, _START = r"(?<![\p{L}\p{N}\p{M}.])", r"(?<![\p{L}\p{N}])"


def _any(words: list[str]) -> str:
    """The words as alternatives, longest first; soft hyphens may stand between letters."""
    one = lambda w: "\u00ad?".join(r"\." if c == "." else c for c in w)
    return "(?:" + "|".join(one(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def _dots(may_end: str, mid: str) -> str:
    """A dot that ends no sentence. The dot is tried first, so that the text around it is looked at nowhere else."""
    return r"\.(?:" + "|".join([
        r"(?=\d)(?<=\d\.)",
        rf"(?={GAP}(?iu:{'|'.join(MONTHS)})\b)(?<=\d\.)",
        # Dotted and spaced initials: e.g. U.S. J. K. z. B. т. е.
        rf"(?=\p{{L}}\.)(?<={_ALONE}\p{{L}}\.)",
        r"(?=\p{L})(?<=\.\p{L}\.)",
        rf"(?={GAP}\p{{L}}{{1,2}}\.)(?<={_ALONE}\p{{L}}\.)",
        rf"(?={GAP}*{INK})(?<={_START}\p{{L}}\.{GAP}\p{{L}}{{1,2}}\.)",
        # One initial: at the start of a line or sentence, behind a capitalised word, or the French title.
        rf"(?={GAP}+\p{{L}})(?<!(?<!\p{{L}})I\.)(?:(?<=(?m:^){GAP}{{0,9}}\p{{L}}\.)|(?<=[{TERMINATORS}]{GAP}{{1,3}}\p{{L}}\.)"
        rf"|(?<=\p{{Lu}}\p{{Ll}}{{1,20}}{GAP}\p{{L}}\.)|(?<=\D{GAP}M\.))",
        rf"(?={GAP}*{INK})(?<={_START}(?iu:{_any(ALWAYS)})\.)",
        rf"(?={GAP}*\d)(?<={_ALONE}(?iu:{_any(BEFORE_NUMBER)})\.)",
        rf"(?={GAP}+\p{{Lu}})(?<={_ALONE}{_any(BEFORE_CAPITAL)}\.)",
        rf"(?={may_end})(?<={_START}(?iu:{_any(MAY_END)})\.)",
        # Dots before a word in mid-sentence.
        rf"(?=\.{{1,9}}+{GAP}*{mid})",
        rf"(?={GAP}*{mid})(?<=\.\.)",
    ]) + ")"


_CASELESS = rf"[\p{{Ll}}\p{{Lo}}&&[^{UNSPACED}]]"
_ON = rf"[,;:)]|{GAP}+(?iu:{_any(GOES_ON)})(?![\p{{L}}\p{{N}}])"


def masked(text: Column) -> Column:
    """The text with line breaks as \\n and placeholders for terminators that end nothing; as long as the text."""
    sub = F.regexp_replace
    t = F.when(text.rlike(r"[\r\x0b\x0c\x{85}\x{2028}\x{2029}]"), F.translate(text, "\r\x0b\x0c\x85\u2028\u2029", "\n" * 6)).otherwise(text)
    parts = F.split(sub(t, _SPANS, f"{OPEN}$0{SHUT}"), OPEN)
    inside = lambda p: F.translate(F.substring_index(p, SHUT, 1), TERMINATORS, PLACEHOLDERS)
    spans = F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(inside(p), F.substring_index(p, SHUT, -1)))), ""
    )
    t = F.when(t.rlike(_MAY_SPAN) | t.contains("://") | t.contains("www."), spans).otherwise(t)
    # In text begun without a capital, or all in capitals, only certain words show that the sentence goes on.
    dots = (
        F.when(~text.rlike(r"\p{Ll}"), sub(t, _dots(_ON, r"[\p{Lu}\p{Lo}]"), DOT))
        .when(text.rlike(r"^[^\p{L}]*\p{Ll}"), sub(t, _dots(_ON, _CASELESS), DOT))
        .otherwise(sub(t, _dots(rf"[,;:)]|{GAP}+\p{{Ll}}", _CASELESS), DOT))
    )
    # List numbers, on a new line or behind a sentence end.
    number = (
        rf"\.(?={GAP})(?:(?<=(?m:^){GAP}{{0,9}}(?:[-*•–—]{GAP}{{0,3}})?\d{{1,3}}\.)"
        rf"|(?={GAP}+\p{{L}})(?<=[{TERMINATORS}]{CLOSERS}{{0,2}}[{BLANK}\n]{{1,3}}\d{{1,3}}\.))"
    )
    t = F.when(text.contains("."), sub(dots, number, DOT)).otherwise(t)
    one = rf"…(?!…)(?<!……)(?:(?={GAP}*{_CASELESS})|(?=[{UNSPACED}]))"
    return F.when(text.contains("…"), sub(t, one, PLACEHOLDERS[TERMINATORS.index("…")])).otherwise(t)


def marked(text: Column) -> Column:
    """The masked text with END after each sentence and line."""
    sub = lambda t, rx: F.regexp_replace(t, rx, f"$0{END}")
    t = masked(text)
    t = sub(t, rf"(?=[{TERMINATORS}])(?<![{TERMINATORS}])(?=[.…]*+[!?。！？؟।॥．｡]|…)[{TERMINATORS}]++{TAIL}(?![,;:，、،])")
    t = sub(t, rf"(?<!\.)\.++{TAIL}(?={GAP}|\n|$|[{UNSPACED}])|\.(?=\p{{Lu}}\p{{Ll}})(?<=[\p{{Ll}}\p{{N}}][\p{{Ll}}\p{{N}}]\.)")
    # A quotation that closes with a terminator ends the sentence it stands at the end of, if a new one begins behind it.
    quoted = rf"(?<=[\p{{L}},:]{GAP}{{1,2}})[\"“«][^\"”»\n]*[{PLACEHOLDERS}]{GAP}?[\"”»](?={GAP}+\p{{Lu}}\p{{Ll}})"
    t = F.when(text.rlike("[\"”»]"), sub(t, quoted)).otherwise(t)
    t = F.when(text.rlike(r"[\x{e00}-\x{e7f}]"), sub(t, rf"(?<=[\x{{e00}}-\x{{e7f}}]){GAP}++(?=[\x{{e00}}-\x{{e7f}}])")).otherwise(t)
    return F.replace(t, F.lit("\n"), F.lit(f"\n{END}"))


def _spans(pieces: Column, total: Column) -> Column:
    """(start, len) of the sentences among the pieces. Runs of pieces are measured in groups, so that long texts stay linear."""
    one = "array<struct<start:int,len:int,word:boolean,alone:boolean>>"
    group = 256

    def step(acc: Column, p: Column) -> Column:
        size = F.length(F.trim(p, F.lit(_SPACES)))
        s = F.struct(
            (acc["at"] + F.length(p) - F.length(F.ltrim(p, F.lit(_SPACES)))).cast("int").alias("start"),
            size.alias("len"),
            p.rlike(r"[\p{L}\p{N}]").alias("word"),
            (acc["fresh"] & (p.endswith("\n") | (acc["at"] + F.length(p) == total))).alias("alone"),
        )
        return F.struct(
            (acc["at"] + F.length(p)).alias("at"), p.endswith("\n").alias("fresh"),
            F.when(F.trim(p) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(s))).alias("out"),
        )

    def steps(acc: Column, g: Column) -> Column:
        inner = F.aggregate(
            F.slice(pieces, g * group + 1, group),
            F.struct(acc["at"].alias("at"), acc["fresh"].alias("fresh"), F.array().cast(one).alias("out")),
            step,
        )
        return F.struct(inner["at"].alias("at"), inner["fresh"].alias("fresh"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("fresh"), F.array().cast(f"array<{one}>").alias("out"))
    groups = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / group).cast("int"))
    sized = F.when(
        F.size(pieces) <= group, F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(True).alias("fresh"), F.array().cast(one).alias("out")), step)["out"]
    ).otherwise(F.flatten(F.aggregate(groups, start, steps, lambda acc: acc["out"])))
    kept = F.filter(sized, lambda s: (s["len"] > 0) & (s["word"] | s["alone"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len")))


def sentences(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a sentence: the other columns, sent_no, sent_start (0-based, in code points), sentence.

    Null and blank texts have none, so their rows vanish. A piece without letters or digits is a sentence only if its line
    holds nothing else. Repeated rows are split each.
    """
    d = texts.withColumn("__p", F.split(marked(F.col(text)), END)).withColumn("__n", F.length(text))
    d = d.filter(F.col(text).rlike(r"(?U)\S")).withColumn("__spans", let(F.col("__p"), lambda p: _spans(p, F.col("__n"))))
    # The outer form, for the other one first computes the spans once more to drop texts without any.
    d = d.select(*texts.columns, F.posexplode_outer("__spans").alias("sent_no", "__s")).filter(F.col("sent_no").isNotNull())
    return d.select(
        *[c for c in texts.columns if c != text], "sent_no", F.col("__s.start").alias("sent_start"),
        F.substring(F.col(text), F.col("__s.start") + 1, F.col("__s.len")).alias("sentence"),
    )


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "convs").select("id", "messages"), "id").select("id", F.posexplode("messages").alias("pos", "m"))
    return c.select("id", "pos", F.col("m.content").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of each message begins."""
    return sentences(message_texts(spark, sf_dir)).select("id", "pos", "sent_start").distinct()


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as its sentences in order."""
    return sentences(message_texts(spark, sf_dir)).distinct()
