"""Text operators over laws: page furniture, heading candidates, numbered chains, articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heading patterns at the start of a line as (style, family, pattern with the number as its group); the first
#: match wins. A heading is capitalised, or has the dash of its family; a line of a table of contents is none.
HEADINGS = (
    ("dash", "dash", r"(?iu)^\s*art[íi]?(?:culo|\.)\s*(\d+)\s*\.?-"),
    ("es_period", "es", r"^[ \t]*(?:ART[ÍI]CULO|Art[íi]culo)[ \t]+(\d+)[ \t]*(?:[°º]|o(?=[ \t]*\.))?[ \t]*\.(?!-)"),
    ("es_alone", "es", r"^[ \t]*(?:ART[ÍI]CULO|Art[íi]culo)[ \t]+(\d+)[ \t]*(?:[°º])?[ \t]*$"),
    ("en_alone", "en", r"^[ \t]*(?:ARTICLE|Article)[ \t]+(\d+)[ \t]*$"),
    ("en_inline", "en", r"^[ \t]*(?:ARTICLE|Article)[ \t]+(\d+)[ \t]*(?:[.:]|[-–—])[ \t]*(?=[A-ZÁÉÍÓÚÑ])"),
)
CONTENTS = r"(?:\.\s?){4,}\s*\d*\s*$|…\s*\d*\s*$"
#: The most that a chain's number may rise by; the longest line that can be a title; lines that begin as body text does.
MAX_GAP, LONGEST_TITLE = 3, 150
BODY = r"^(?:\(?\d+[.)]|\([a-z]\))"
BLANKS = " \t\n\r\x0b\f"
#: Common words of each language that laws are in.
LANGUAGES = {
    "es": "de la que el en los del las por para con una se su al lo datos sus como ley".split(),
    "en": "the of and to in shall be or for by with that this which data on is as an are".split(),
}


def lines_of(pages: DataFrame) -> DataFrame:
    """doc, page, pos, line of pages (doc, page, text)."""
    return pages.select("doc", "page", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line"))


def masked(line: Column) -> Column:
    return F.regexp_replace(F.btrim(line), "[0-9]+", "#")


def edge_lines(pages: DataFrame, reach: int = 2) -> DataFrame:
    """The first and last `reach` non-blank lines of each page."""
    own = lines_of(pages).where(F.btrim("line") != "")
    page = Window.partitionBy("doc", "page")
    numbered = own.withColumns({"up": F.row_number().over(page.orderBy("pos")), "down": F.row_number().over(page.orderBy(F.desc("pos")))})
    return numbered.where((F.col("up") <= reach) | (F.col("down") <= reach)).select("doc", "page", "pos", "line")


def is_heading(line: Column) -> Column:
    out = F.lit(False)
    for *_, pattern in HEADINGS:
        out = out | F.btrim(line, F.lit(BLANKS)).rlike(pattern)
    return out


def furniture(pages: DataFrame) -> DataFrame:
    """doc, norm: edge lines (digits masked) of at least 3 pages and half of them; a heading never is one."""
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = edge_lines(pages).where(~is_heading(F.col("line"))).groupBy("doc", masked(F.col("line")).alias("norm")).agg(F.count_distinct("page").alias("n"))
    return seen.join(total, "doc").where((F.col("n") >= 3) & (2 * F.col("n") >= F.col("pages"))).select("doc", "norm")


#: Marks of consolidated texts (a line of its own, or around words), headings with spaced letters, ligatures.
MARKER_LINE = r"^\s*[▼►◄]\s*[A-Z]?\d*\s*$"
INLINE_MARKER = r"►\s*[A-Z]\d+\s*|\s*◄"
SPACED = r"^\s*(?:\S ){4,}\S?\s*$"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def cleaned(pages: DataFrame) -> DataFrame:
    """doc, page, text, removed, markers, spaced, ligatures: the pages without furniture, marks and spaced headings, and counts of what went.

    A page of nothing else has an empty text. A marker counts once a line; ligatures are counted in what is left.
    """
    edges = edge_lines(pages).withColumn("norm", masked(F.col("line"))).join(furniture(pages), ["doc", "norm"], "left_semi").select("doc", "page", "pos", F.lit(True).alias("gone"))
    every = lines_of(pages).join(edges, ["doc", "page", "pos"], "left")
    kind = F.when(F.col("gone"), "removed").when(F.col("line").rlike(MARKER_LINE), "marker").when(F.col("line").rlike(SPACED), "spaced").when(F.col("line").rlike(INLINE_MARKER), "inline").otherwise("kept")
    every = every.withColumn("kind", kind)
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind").isin("inline", "kept"), F.struct("pos", F.regexp_replace("line", INLINE_MARKER, "").alias("line")))))
    counts = [F.count_if(F.col("kind") == "removed").alias("removed"), F.count_if(F.col("kind").isin("marker", "inline")).alias("markers"), F.count_if(F.col("kind") == "spaced").alias("spaced")]
    one = every.groupBy("doc", "page").agg(ordered.alias("l"), *counts)
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    whole = one.select("doc", "page", text.alias("text"), "removed", "markers", "spaced").withColumn("ligatures", F.regexp_count("text", F.lit(f"[{''.join(LIGATURES)}]")).cast("bigint"))
    plain = F.col("text")
    for sign, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(sign), F.lit(letters))
    return whole.withColumn("text", plain)


def candidates(laws: DataFrame) -> DataFrame:
    """law, start, family, number, style, marker: lines that read as headings, from their first letter; marker is the part matched."""
    lines = laws.select("law", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.sum(F.char_length("line") + 1).over(Window.partitionBy("law").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("at", F.coalesce(before, F.lit(0)))
    line = F.regexp_replace("line", "\r$", "")
    which = F.coalesce(*[F.when(line.rlike(p), F.lit(i)) for i, (_, _, p) in enumerate(HEADINGS)])
    placed = placed.withColumn("which", which).where(F.col("which").isNotNull() & ~line.rlike(CONTENTS))
    pick = lambda values: F.get(F.array(*values), F.col("which"))
    number = pick([F.regexp_extract(line, p, 1) for *_, p in HEADINGS])
    marker = F.btrim(pick([F.regexp_extract(line, p, 0) for *_, p in HEADINGS]), F.lit(BLANKS))
    start = F.col("at") + F.char_length("line") - F.char_length(F.ltrim("line", F.lit(BLANKS)))
    found = placed.select(
        "law", start.alias("start"), pick([F.lit(f) for _, f, _ in HEADINGS]).alias("family"), number.try_cast("int").alias("number"), pick([F.lit(x) for x, *_ in HEADINGS]).alias("style"), marker.alias("marker")
    )
    return found.where("number is not null")


def chains_of(starts: list[int], numbers: list[int]) -> list[int]:
    """Places of the longest chain of one family's candidates, in order of their starts; empty if there are none.

    A chain begins at a candidate with number 1 (at the first one if there is none) and takes each next candidate whose number is 1
    to MAX_GAP above its last. Chains that have come to the same number go on alike, so of those that end in a number only the best is
    kept, the longer or, of equal ones, the later begun: one pass with a table from last number to chain, and back along the links.
    """
    if not numbers:
        return []
    ones = [i for i, n in enumerate(numbers) if n == 1] or [0]
    begins = set(ones)
    before, length, first = [-1] * len(numbers), [0] * len(numbers), [-1] * len(numbers)
    ends: dict[int, int] = {}  # last number of a chain: its last place
    for i, number in enumerate(numbers):
        # all chains that can take this candidate take it; of them the best goes on
        taken = [ends.pop(number - gap) for gap in range(1, MAX_GAP + 1) if number - gap in ends]
        if i in begins:
            length[i], first[i] = 1, i
        for end in taken:
            if (length[end] + 1, first[end]) > (length[i], first[i]):
                before[i], length[i], first[i] = end, length[end] + 1, first[end]
        if length[i] and (number not in ends or (length[i], first[i]) > (length[ends[number]], first[ends[number]])):
            ends[number] = i
    best = max(range(len(numbers)), key=lambda i: (length[i], first[i]))
    chain = []
    while best >= 0:
        chain.append(best)
        best = before[best]
    return chain[::-1]


def longest_chain(found: DataFrame) -> DataFrame:
    """law, family, chain: per law the longest chain of rising numbers (steps of 1 to MAX_GAP) from an article 1, of one family.

    Of equal lengths the later start wins. A law's candidates, a short row a heading, are one task's; its text is not there.
    """
    grouped = found.groupBy("law", "family").agg(F.array_sort(F.collect_list(F.struct("start", "number", "style", "marker"))).alias("c"))

    @F.pandas_udf("array<int>")
    def places(starts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([chains_of(list(s), list(n)) for s, n in zip(starts, numbers, strict=True)])

    chained = grouped.withColumn("at", places(F.transform("c", lambda x: x["start"]), F.transform("c", lambda x: x["number"])))
    chains = chained.select("law", "family", F.transform("at", lambda i: F.get(F.col("c"), i)).alias("chain"))
    best = chains.groupBy("law").agg(F.max_by(F.struct("family", "chain"), F.struct(F.size("chain"), F.get("chain", F.lit(0))["start"])).alias("b"))
    return best.select("law", "b.family", "b.chain")


def title(style: Column, marker: Column, block: Column) -> Column:
    """What follows the marker on its line (dash), its first sentence, or for a marker alone the next line that is no body text."""
    lines = F.split(block, r"\r?\n")
    after = F.substring(F.get(lines, F.lit(0)), F.char_length(marker) + 1, F.char_length(block))
    dash = F.btrim(F.ltrim(after, F.lit(" .–-\t")), F.lit(BLANKS))
    trimmed = F.btrim(after, F.lit(BLANKS))
    until = F.regexp_extract(trimmed, r"^(.*?)\.(?:\s|$)", 1)
    sentence = F.btrim(F.when(trimmed.rlike(r"\.(?:\s|$)"), until).otherwise(trimmed), F.lit(" .\t"))
    rest = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    following = F.coalesce(F.get(rest, F.lit(0)), F.lit(""))
    below = F.when((F.char_length(following) > LONGEST_TITLE) | following.rlike(BODY), "").otherwise(F.rtrim(following, F.lit(" .")))
    return F.when(style == "dash", dash).when(style.endswith("_alone"), below).otherwise(sentence)


def articles(laws: DataFrame, chains: DataFrame) -> DataFrame:
    """law, number, title, start, stop, text: from each heading of the chain to the next."""
    heads = chains.select("law", F.explode("chain").alias("h")).select("law", "h.*")
    cut = heads.withColumn("stop", F.lead("start").over(Window.partitionBy("law").orderBy("start"))).join(laws, "law")
    stop = F.coalesce("stop", F.char_length("text"))
    own = F.btrim(F.substring(F.col("text"), F.col("start") + 1, stop - F.col("start")), F.lit(BLANKS))
    cut = cut.select("law", "number", "style", "marker", "start", stop.alias("stop"), own.alias("body"))
    return cut.select("law", "number", title(F.col("style"), F.col("marker"), F.col("body")).alias("title"), "start", "stop", "body")


def rejected(found: DataFrame, chains: DataFrame) -> DataFrame:
    """law, rejected: heading-like lines that the chain leaves out."""
    kept = chains.select("law", F.size("chain").alias("kept"))
    every = found.groupBy("law").agg(F.count(F.lit(1)).alias("n"))
    return every.join(kept, "law", "left").select("law", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("rejected"))


def skipped(chains: DataFrame) -> DataFrame:
    """law, number: numbers missing inside the chain."""
    own = chains.select("law", F.explode("chain").alias("h")).select("law", "h.number", "h.start")
    after = own.withColumn("next", F.lead("number").over(Window.partitionBy("law").orderBy("start"))).where("next > number + 1")
    return after.select("law", F.explode(F.sequence(F.col("number") + 1, F.col("next") - 1)).alias("number"))


def language(text: Column) -> Column:
    """en if the text has more of the English words than of the Spanish, else es."""
    words = F.split(F.lower(text), "[^a-záéíóúñü]+")
    count = lambda code: F.size(F.filter(words, lambda w: w.isin(LANGUAGES[code])))
    return F.when(count("en") > count("es"), "en").otherwise("es")
