"""How texts are read by scores: per word or per character, in lower case or not; signs of odd captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.text import let

#: Languages scored per character, their punctuation and what it counts as, and their characters.
CHAR_LANGUAGES = ["zh", "ja", "ko"]
WIDE = "￥％＃＠，。？！、；：（）【】《》「」『』“”‘’—–·　﹏～"
NARROW = "$%#@,.?!,;:()[]<>\"\"\"\"\"\"''--. _~"
IDEOGRAPH = "[㐀-䶿一-鿿]"
SPACE = r"\s+"


def by_character(lang: Column) -> Column:
    """True where texts in this language (such as ``zh_CN``) are scored per character; false for null."""
    return F.coalesce(F.lower(F.split_part(lang, F.lit("_"), F.lit(1))).isin(CHAR_LANGUAGES), F.lit(False))


def scored(text: Column, per_character: Column, lowercase: bool = False) -> Column:
    """The text as the scores split it at spaces; per character, spaces and line ends go and wide punctuation narrows."""
    cased = F.lower(text) if lowercase else text
    tight = F.replace(F.translate(F.regexp_replace(cased, "[ \n]", ""), WIDE, NARROW), F.lit("…"), F.lit("..."))
    return F.when(per_character, F.array_join(F.regexp_extract_all(tight, F.lit("(?s)."), F.lit(0)), " ")).otherwise(cased)


def spaced_ideographs(text: Column) -> Column:
    """A space on either side of each ideograph, none doubled before it and none left at the ends."""
    after = F.regexp_replace(text, IDEOGRAPH, "$0 ")
    return F.regexp_replace(F.regexp_replace(after, f"([^ ])({IDEOGRAPH})", "$1 $2"), r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda x: x != "")


def letters_alone(text: Column) -> tuple[Column, Column]:
    """Two sums for a share that spans many texts: tokens that are one letter, and tokens; marks at their ends do not count."""
    bare = F.filter(F.transform(tokens(text), lambda x: F.btrim(x, F.lit(".,!?-'\""))), lambda x: x != "")
    return F.size(F.filter(bare, lambda x: x.rlike(r"^\p{L}$"))).cast("long"), F.size(bare).cast("long")


def loops(text: Column, n: int = 3, least: int = 4) -> Column:
    """True where some run of n words occurs ``least`` times: in sorted order it then equals its neighbour that far on."""

    def repeated(grams: Column) -> Column:
        at = F.sequence(F.lit(least), F.size(grams))
        found = F.exists(at, lambda i: F.get(grams, i - 1) == F.get(grams, i - least))
        return F.when(F.size(grams) >= least, found).otherwise(F.lit(False))

    def runs(words: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, F.sort_array(made)).otherwise(F.array().cast("array<string>"))

    return let(let(tokens(F.lower(text)), runs), repeated)


def shown_prefix(items: Column, stops: list) -> Column:
    """The items before the first one that ends the text; all of them if none does."""
    at = F.array_position(F.transform(items, lambda x: x.isin(stops)), True)
    return F.when(at > 0, F.slice(items, F.lit(1), (at - 1).cast("int"))).otherwise(items)


def join_units(text: Column, separator: str) -> Column:
    """The texts of the units of one span with single spaces for what stands between them."""
    return F.array_join(tokens(F.replace(text, F.lit(separator), F.lit(" "))), " ")


def base_id(name: Column) -> Column:
    """A file's name without folders, its last suffix, and the number of its segment."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, r"_segment_\d+", "")


def slug(label: Column) -> Column:
    """A label for file names: letters and digits in lower case, anything else an underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(label, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))


def unit_text(text: Column, separator: str) -> Column:
    """The text of a span with its units parted by single spaces."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(separator), F.lit(" ")), r"\s+", " "))
