"""Caption text: cleaning, language checks, words and shingles, all as column expressions."""

from __future__ import annotations

import html
import html.entities
import json
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word and annotation patterns, and the closed word sets.
WORD = r"[A-Za-z][\p{L}\p{N}_']*"
NOISE_WORDS = ["applause", "background", "foreign", "gentle", "inaudible", "laugh", "laughs", "laughter", "music", "piano", "silence", "silent"]
FUNCTION_WORDS = (
    "the a an and or but if then than that this these those of to in on at for with from by as is are was were be been being am do does did have "
    "has had will would can could should may might must not no nor so such it its he she we they them his her their our us you your i me my there "
    "here what when where who whom which how why all any both each few more most other some only own same too very"
).split()
FOLDED = "‘’“”–— "
FOLDED_TO = "''\"\"-- "
TIMING = r"<\d{1,2}:\d{2}:\d{2}[.,]\d{3}>"
TAG = r"<[^>]+>"
BRACKETS = r"\[[^\[\]\n]{0,80}\]|\*[^*\n]{0,80}\*"
PAREN = r"\([^()\n]{0,80}\)"
ENTITY = r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,7};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
CLOSED_ENTITY = ENTITY.replace(";?", ";")
PREFIX = r"^[A-Z][A-Z\s_-]{1,30}:\s*"
GLYPHS = "[♪♫♬♩►◄]+"
LEADING = "^[\\s♪♫•·>»-]+"
TRAILING = "[\\s♪♫•·]+$"
SPEAKER = r"^[A-Z][A-Za-z0-9_'-]{0,20}(\s+[A-Z][A-Za-z0-9_'-]{0,20})?:\s+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once; named in a lambda directly it could be computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rewrite(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """``text`` with each match of ``pattern`` replaced by ``made`` of it; what stands between the matches is never looked at."""

    def joined(parts: Column) -> Column:
        put = F.zip_with(parts["between"], parts["found"], lambda x, y: F.concat(x, F.coalesce(made(y), F.lit(""))))
        return F.array_join(put, "")

    pieces = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(pieces, joined)).otherwise(text)


@cache
def _entity_names() -> str:
    """Named entities, and the code points that stand for a Windows character, as a JSON map."""
    named = {f"&{k}": v for k, v in html.entities.html5.items()}
    return json.dumps(named | {str(k): html.unescape(f"&#{k};") for k in range(128, 160)})


def unescape(text: Column, closed: bool = False) -> Column:
    """Entities by name or number; an unknown name stays, and a number that is no character becomes the replacement mark.

    Without a semicolon at their end they are entities too, as in HTML, unless only ``closed`` ones are asked for.
    """
    names = F.from_json(F.lit(_entity_names()), "map<string,string>")

    def decoded(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?([0-9a-fA-F]+)", 1)
        number = F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        good = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        by_number = F.when(number.between(128, 159), F.try_element_at(names, number.cast("string"))).when(good, sign).otherwise("\ufffd")
        return F.when(F.substring(x, 2, 1) == "#", by_number).otherwise(F.coalesce(F.try_element_at(names, x), x))

    return F.when(F.contains(text, F.lit("&")), rewrite(text, CLOSED_ENTITY if closed else ENTITY, decoded)).otherwise(text)


def is_noise(text: Column) -> Column:
    """True for a caption that says nothing but what is to be heard: no word is left, or only words for sounds."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), PREFIX, ""), GLYPHS, " ")
    bare = F.lower(F.regexp_replace(bare, r"^[\[\](){}\s]+|[\[\](){}\s]+$", ""))
    found = F.regexp_extract_all(bare, F.lit("[a-z]+"), F.lit(0))
    return (bare == "") | ((F.size(found) > 0) & F.forall(found, lambda w: w.isin(NOISE_WORDS)))


def clean_caption(text: Column, closed_entities: bool = False) -> Column:
    """Normalise a cue.  The order matters: entities are decoded before tags go, or coded markup would stay.

    A group in round brackets goes only if it is noise.  A pair of quotation marks around the whole goes, and so do
    marks left over after the final stop.
    """
    t = unescape(F.regexp_replace(text, TIMING, " "), closed_entities)
    t = F.translate(t, FOLDED, FOLDED_TO)
    t = F.regexp_replace(t, TAG, " ")
    t = F.regexp_replace(t, BRACKETS, " ")
    t = rewrite(t, PAREN, lambda x: F.when(is_noise(x), " ").otherwise(x))
    t = F.regexp_replace(t, LEADING, "")
    t = F.regexp_replace(t, TRAILING, "")
    t = F.regexp_replace(t, SPEAKER, "")
    t = F.regexp_replace(t, r"\s+([,.!?;:])", "$1")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(t, r"""(?s)^(?:"(.*)"|'(.*[.!?])')$""", "$1$2")
    return F.regexp_replace(F.trim(t), """(?<=[.!?])["']+$""", "")


def _runs(array: Column, n: int) -> Column:
    """All runs of n neighbours, joined; none where there are fewer."""
    starts = lambda a: F.sequence(F.lit(1), F.size(a) - (n - 1))
    joined = lambda a: F.transform(starts(a), lambda i: F.array_join(F.slice(a, i, n), " "))
    none = F.array().cast("array<string>")
    return let(array, lambda a: F.when(F.size(a) >= n, joined(a)).otherwise(none))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shingles(array: Column, n: int) -> Column:
    """Distinct runs of n words; none where there are fewer words."""
    return F.array_distinct(_runs(array, n))


def shingle_hashes(array: Column, n: int) -> Column:
    """The distinct runs of n words as 64-bit hashes, for joins that only ask which are equal."""
    starts = lambda a: F.sequence(F.lit(1), F.size(a) - (n - 1))
    hashed = lambda a: F.array_distinct(F.transform(starts(a), lambda i: F.xxhash64(F.slice(a, i, n))))
    return let(array, lambda a: F.when(F.size(a) >= n, hashed(a)).otherwise(F.array().cast("array<bigint>")))


def function_word_share(text: Column) -> Column:
    """Share of the words that belong to the closed set; 0 without words."""
    found = F.transform(words(text), F.lower)
    known = lambda a: F.size(F.filter(a, lambda w: w.isin(FUNCTION_WORDS)))
    return let(found, lambda a: F.when(F.size(a) > 0, known(a) / F.size(a)).otherwise(F.lit(0.0)))


def non_latin_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]+", ""))
    return F.when(letters > 0, (letters - latin) / letters).otherwise(F.lit(0.0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.slice(same, 1, F.greatest(n, F.lit(1))), False)
    return F.when(n == 0, F.lit(0)).when(first == 0, n).otherwise(first - 1).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    return _runs(tokens, n)
