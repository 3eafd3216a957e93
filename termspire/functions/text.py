"""Text to terms, with built-in string functions only."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words besides white space.
SEPARATORS = r"""0-9!@#$%^&*()_+={}\[\]:;<>,.?~\\/|'"`-"""
WHITE_SPACE = r" \t\n\f\r"

_SEPARATOR_RUN = f"[{WHITE_SPACE}{SEPARATORS}]+"
_WHITE_SPACE_RUN = f"[{WHITE_SPACE}]+"


@lru_cache(maxsize=None)
def accent_table() -> tuple[str, str]:
    """The two arguments of `translate` that strip accents, made from the Unicode database.

    A character maps to what is left of its decomposition without the marks. Characters that are
    marks themselves are deleted, so they stand at the end, beyond the replacements.
    """
    source, target, deleted = [], [], []
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(char)[0] == "M":
            deleted.append(char)
        elif unicodedata.decomposition(char):
            kept = (c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c)[0] != "M")
            plain = unicodedata.normalize("NFC", "".join(kept))
            if plain != char and len(plain) == 1:
                source.append(char)
                target.append(plain)
    return "".join(source + deleted), "".join(target)


# Hangul letters that combine: leading, vowel and trailing ones, as the Unicode standard numbers them.
_LEAD, _VOWEL, _TRAIL, _SYLLABLE = 0x1100, 0x1161, 0x11A7, 0xAC00
_LEADS, _VOWELS, _TRAILS = 19, 21, 28


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def compose_hangul(text: Column) -> Column:
    """Join Hangul letters to syllables, as the composed form of Unicode does.

    Nothing else composes once the marks are gone. One pass over the characters: a letter joins the
    one before it, or is appended. U+11A7, which stands for no trailing letter, vanishes in a syllable,
    as it does in other engines' composition.
    """

    def join(done: Column, char: Column) -> Column:
        last, code = F.ascii(F.right(done, F.lit(1))), F.ascii(char)
        lead, vowel, trail = last - _LEAD, code - _VOWEL, code - _TRAIL
        syllable = last - _SYLLABLE
        pair = lead.between(0, _LEADS - 1) & vowel.between(0, _VOWELS - 1)
        open_end = syllable.between(0, _LEADS * _VOWELS * _TRAILS - 1) & (syllable % _TRAILS == 0)
        joined = F.when(pair, (lead * _VOWELS + vowel) * _TRAILS + _SYLLABLE).when(
            open_end & trail.between(0, _TRAILS - 1), last + trail
        )
        before = F.substring(done, F.lit(1), F.char_length(done) - 1)
        return F.when(joined.isNull(), F.concat(done, char)).otherwise(
            F.concat(before, _character(joined))
        )

    return F.aggregate(F.split(text, ""), F.lit(""), join)


def strip_accents(text: Column) -> Column:
    """Text without accents, as decomposing it, dropping the marks and composing it again gives.

    The table works character by character, which is enough but for Hangul that is written in
    letters; only rows that hold such letters are composed.
    """
    source, target = accent_table()
    is_ascii = F.octet_length(text) == F.char_length(text)
    plain = F.translate(text, source, target)
    return (
        F.when(is_ascii, text)
        .when(plain.rlike("[\u1100-\u11FF]"), compose_hangul(plain))
        .otherwise(plain)
    )


def normalise(text: Column) -> Column:
    """Lower case without accents. Every capital sigma gives the same small sigma, wherever it stands."""
    return F.lower(F.replace(strip_accents(text), F.lit("Σ"), F.lit("σ")))


def _without_empty(words: Column) -> Column:
    return F.array_remove(words, "")


def tokenize(text: Column) -> Column:
    """Normalised terms of a text: lower case, no accents, split at separators and white space."""
    return _without_empty(F.split(normalise(text.cast("string")), _SEPARATOR_RUN))


def _sql_compose(text: str) -> str:
    """`compose_hangul` as SQL."""
    last, code = "ascii(right(done, 1))", "ascii(char)"
    lead, vowel, trail = f"({last} - {_LEAD})", f"({code} - {_VOWEL})", f"({code} - {_TRAIL})"
    syllable = f"({last} - {_SYLLABLE})"
    pair = f"{lead} BETWEEN 0 AND {_LEADS - 1} AND {vowel} BETWEEN 0 AND {_VOWELS - 1}"
    open_end = f"{syllable} BETWEEN 0 AND {_LEADS * _VOWELS * _TRAILS - 1} AND {syllable} % {_TRAILS} = 0"
    joins_end = f"{open_end} AND {trail} BETWEEN 0 AND {_TRAILS - 1}"
    made = [f"({lead} * {_VOWELS} + {vowel}) * {_TRAILS} + {_SYLLABLE}", f"{last} + {trail}"]
    written = [f"decode(unhex(lpad(hex({m}), 4, '0')), 'UTF-16BE')" for m in made]
    before = "substring(done, 1, char_length(done) - 1)"
    step = (
        f"CASE WHEN {pair} THEN concat({before}, {written[0]}) "
        f"WHEN {joins_end} THEN concat({before}, {written[1]}) ELSE concat(done, char) END"
    )
    return f"aggregate(split({text}, ''), '', (done, char) -> {step})"


def sql_tokenize() -> str:
    """The body of a SQL function `tokenize(text)` that does the same."""

    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    source, target = accent_table()
    plain = f"translate(cast(text AS STRING), {quoted(source)}, {quoted(target)})"
    composed = f"CASE WHEN {plain} RLIKE '[\u1100-\u11FF]' THEN {_sql_compose(plain)} ELSE {plain} END"
    lowered = f"lower(replace({composed}, 'Σ', 'σ'))"
    return f"array_remove(split({lowered}, {quoted(_SEPARATOR_RUN)}), '')"


def split_words(text: Column, drop_apostrophes: bool = False) -> Column:
    """Words of a text split at white space only: no lower-casing, punctuation kept."""
    if drop_apostrophes:
        text = F.replace(text, F.lit("'"), F.lit(""))
    return _without_empty(F.split(text, _WHITE_SPACE_RUN))
