"""Column functions on names, identifiers and texts."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that carry no meaning in names (English and Spanish).
STOP_WORDS = "a an and as at by for from in into of on or the to with de del el en la las los para por un una y".split()
#: Vocabularies that an ontology borrows rather than defines.
BORROWED = ("http://www.w3.org/", "http://purl.org/", "http://xmlns.com/")


def local_name(iri: Column) -> Column:
    """After '#', else after the last '/'."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def namespace(iri: Column) -> Column:
    return F.substring(iri, F.lit(1), F.length(iri) - F.length(local_name(iri)))


def humanize(name: Column) -> Column:
    """CamelCase, '_' and '-' to words."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.btrim(F.regexp_replace(spaced, "[_\\- ]+", " "))


def trim_words(text: Column, limit: int = 240) -> Column:
    """White space collapsed; over the limit, cut at the last space within it and marked by '...'."""
    flat = F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    cut = F.regexp_extract(F.substring(flat, 1, limit), "^(.*) ", 1)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("...")))


#: The plural endings that are cut, as (ending, what stands for it, least length, endings that stay).
PLURALS = (("ies", "y", 5, ()), ("s", "", 4, ("ss", "us", "is")))


def singular(token: Column) -> Column:
    """'ies' to 'y'; a final 's' goes, except of 'ss', 'us', 'is'."""
    out = token
    for ending, instead, least, stay in reversed(PLURALS):
        fits = token.endswith(ending) & (F.char_length(token) >= least)
        for kept in stay:
            fits = fits & ~token.endswith(kept)
        out = F.when(fits, F.regexp_replace(token, f"{ending}$", instead)).otherwise(out)
    return out


@cache
def accents() -> tuple[str, str, dict[str, str]]:
    """Of Unicode's compatibility decompositions without combining marks, those with a letter or digit of ASCII: characters that give one
    character, those characters in the same order (then nothing, for the marks, which go), and characters that give several."""
    single, several, marks = {}, {}, []
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
        elif unicodedata.decomposition(char):
            plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
            if len(plain) == 1 and plain.isascii():
                single[char] = plain
            elif any(x.isascii() and x.isalnum() for x in plain):
                several[char] = plain
    return "".join(single) + "".join(marks), "".join(single.values()), several


def unaccented(text: Column) -> Column:
    """text in ASCII as far as its characters decompose to it; combining marks are gone. Plain texts are left as they are."""
    chars, plain, several = accents()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    whole = F.when(text.rlike("[" + "".join(several) + "]"), spelt).otherwise(text)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(whole, chars, plain))


def normalize_name(name: Column) -> Column:
    """Words of an identifier without accents, stop words and plurals, in lower case."""
    plain = F.lower(unaccented(humanize(name)))
    tokens = F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))
    return F.array_join(F.transform(tokens, singular), " ")


def token_sort(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A row of the table of a text up to this long is held as the bits of one number.
ROW_BITS = 62


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def bit_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; b has ROW_BITS characters at most: each character of a is a few steps on one number."""
    one = F.lit(1).cast("bigint")
    places = F.transform(chars(b), lambda y, i: F.struct(y.alias("y"), F.call_function("shiftleft", one, i).alias("bit")))
    full = F.call_function("shiftleft", one, F.char_length(b)) - 1

    def last_row(known: Column) -> Column:
        def step(row: Column, x: Column) -> Column:
            hit = row.bitwiseAND(F.aggregate(known["places"], F.lit(0).cast("bigint"), lambda acc, e: F.when(e["y"] == x, acc + e["bit"]).otherwise(acc)))
            return (row + hit).bitwiseOR(row - hit).bitwiseAND(known["full"])

        return F.aggregate(chars(a), known["full"], step)

    return F.char_length(b) - F.bit_count(let(F.struct(places.alias("places"), full.alias("full")), last_row))


def long_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of texts of any length, row by row of the table, as a fold over the characters."""

    def last_cell(known: Column) -> Column:
        def step(row: Column, x: Column) -> Column:
            def cell(acc: Column, y: Column) -> Column:
                up, diagonal = F.get(row, F.size(acc)), F.get(row, F.size(acc) - 1)
                best = F.when(x == y, diagonal + 1).otherwise(F.greatest(up, F.element_at(acc, -1)))
                return F.concat(acc, F.array(best))

            return F.aggregate(known, F.array(F.lit(0)), cell)

        first = F.transform(F.sequence(F.lit(0), F.size(known)), lambda _: F.lit(0))
        return F.element_at(F.aggregate(chars(a), first, step), -1)

    return let(chars(b), last_cell)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    swap = F.char_length(a) < F.char_length(b)
    both = F.struct(F.when(swap, b).otherwise(a).alias("more"), F.when(swap, a).otherwise(b).alias("less"))
    of = lambda t: F.when(F.char_length(t["less"]) <= ROW_BITS, bit_subsequence(t["more"], t["less"])).otherwise(long_subsequence(t["more"], t["less"]))
    return let(both, of)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (len a + len b) of the token-sorted names; 0 if one is empty."""
    sorted_ = F.struct(token_sort(a).alias("x"), token_sort(b).alias("y"))
    ratio = lambda t: 2.0 * common_subsequence(t["x"], t["y"]) / (F.char_length(t["x"]) + F.char_length(t["y"]))
    return F.when((a == "") | (b == ""), 0.0).otherwise(let(sorted_, ratio))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, clipped to 0..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot))


def rounded(value: Column, digits: int) -> Column:
    """A number that is not negative, to so many digits; a half of its multiple by a power of ten goes up, as in SQL on doubles (round of Spark looks at the shortest decimals instead)."""
    scale = 10.0**digits
    return (F.floor(value * scale) + F.when(value * scale - F.floor(value * scale) >= 0.5, 1).otherwise(0)) / scale


def primary_language(tag: Column) -> Column:
    return F.lower(F.substring_index(tag, "-", 1))


def semantic_text(name: Column, label: Column, definition: Column, limit: int = 240) -> Column:
    """Humanised name, the label if it says more, the trimmed definition, joined by '. '."""
    words = humanize(name)
    return F.concat_ws(". ", words, F.when(F.lower(label) != F.lower(words), label), F.when(definition != "", trim_words(definition, limit)))
