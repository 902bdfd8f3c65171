"""Legacy glyphs to Unicode Bengali: the steps as column expressions, and as one Arrow function.

The steps, in order: clean up white space; substitute glyph sequences, longer ones
first; put signs in their logical order; join vowel signs; move reph; keep
ya-phala from merging; normalise (NFC). None looks across white space but the
first, so the Arrow function cuts its column into words, does each distinct word
once and puts the texts together again, all of it by Arrow's kernels but the steps.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import tables
from .arrow import by_pieces

CONSONANT = "[\u0995-\u09b9\u09ce\u09dc\u09dd\u09df]"
VOWEL_SIGN = "[\u09be-\u09c3\u09c7\u09c8\u09cb\u09cc\u09d7]"
LEADING_SIGN = "[\u09bf\u09c7\u09c8]"
MARK = "[\u0981-\u0983]"
HALANT, RA, YA, JOINER = "\u09cd", "\u09b0", "\u09af", "\u200d"
E_SIGN, AA_SIGN, O_SIGN, AU_TAIL, AU_SIGN = "\u09c7", "\u09be", "\u09cb", "\u09d7", "\u09cc"

#: (pattern, replacement) of the steps that are a regular expression each; Java's and the regex module's syntax are the same here.
REORDER_LEADING = (f"({LEADING_SIGN})({CONSONANT}(?:{HALANT}{CONSONANT})*)", r"\2\1")
REORDER_CONJUNCT = (f"({VOWEL_SIGN})((?:{HALANT}{CONSONANT})+)", r"\2\1")
REORDER_MARK = (f"({MARK})({VOWEL_SIGN})", r"\2\1")
REPH = (f"(?:\\G|(?<!{HALANT}))({CONSONANT}{VOWEL_SIGN}?){RA}{HALANT}", RA + HALANT + r"\1")
YA_PHALA = (f"(?<![\u200c\u200d]){RA}{HALANT}{YA}", RA + JOINER + HALANT + YA)


def _replaced(text: Column, step: tuple[str, str]) -> Column:
    return F.regexp_replace(text, step[0], re.sub(r"\\(\d)", r"$\1", step[1]))


def pre_normalize(text: Column) -> Column:
    """Without soft hyphens; no-break spaces are spaces; carriage returns, with a line feed after them or not, are one line feed."""
    text = F.translate(text, "\u00ad", "")
    text = F.regexp_replace(text, "\r([\r\u00a0]*)\n?", "$1\n")
    return F.translate(text, "\u00a0\r", " ")


def _ordered(level: dict[str, str]) -> list[str]:
    """Keys in an order in which replacing one by one is replacing the leftmost: those whose end begins another go first."""
    starts = {k[0] for k in level}
    return sorted((k for k in level if "\u00ad" not in k), key=lambda k: (not any(c in starts for c in k[1:]), k))


def substitute(text: Column) -> Column:
    """Glyphs by their text, as a chain of built-in functions."""
    for n in (4, 3, 2):
        level = tables.glyphs()[n]
        for key in _ordered(level):
            text = F.replace(text, F.lit(key), F.lit(level[key]))
    singles = tables.glyphs()[1]
    for key in sorted(singles):
        if len(singles[key]) > 1:
            text = F.replace(text, F.lit(key), F.lit(singles[key]))
    plain = sorted(k for k in singles if len(singles[k]) == 1)
    return F.translate(text, "".join(plain), "".join(singles[k] for k in plain))


def swap_leading_signs(text: Column) -> Column:
    return _replaced(text, REORDER_LEADING)


def reorder_conjuncts(text: Column) -> Column:
    return _replaced(text, REORDER_CONJUNCT)


def reorder_marks(text: Column) -> Column:
    return _replaced(text, REORDER_MARK)


def join_vowel_signs(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(E_SIGN + AA_SIGN), F.lit(O_SIGN)), F.lit(E_SIGN + AU_TAIL), F.lit(AU_SIGN))


def move_reph(text: Column) -> Column:
    return _replaced(text, REPH)


def keep_ya_phala(text: Column) -> Column:
    return _replaced(text, YA_PHALA)


def post_passes(text: Column) -> Column:
    for step in (swap_leading_signs, reorder_conjuncts, reorder_marks, join_vowel_signs, move_reph, keep_ya_phala):
        text = step(text)
    return text


_LEADING, _CONJUNCT, _MARK, _YA_PHALA = (re.compile(p[0]) for p in (REORDER_LEADING, REORDER_CONJUNCT, REORDER_MARK, YA_PHALA))
_REPH = regex.compile(REPH[0])
_RETURNS = "\r([\r\u00a0]*)\n?"


class Words(dict[str, str]):
    """Words that were converted before, and about how many bytes they take."""

    size = 0

    def add(self, words: list[str], done: Iterable[str]) -> None:
        self.update(zip(words, done))
        self.size += self.cost(words)

    def forget(self) -> None:
        self.clear()
        self.size = 0

    @staticmethod
    def cost(words: list[str]) -> int:
        return 250 * len(words) + 6 * sum(map(len, words))


class Converter:
    """The steps on Python strings and Arrow columns, with the words that were converted before; forgets all when they take more bytes than most.

    No step looks across white space, so all new words of a batch go through a step at once, with spaces between.
    """

    def __init__(self, glyphs: dict[int, dict[str, str]], most: int = 32 << 20) -> None:
        self.most = most
        self.levels = [(re.compile("|".join(map(re.escape, sorted(glyphs[n])))), glyphs[n]) for n in (4, 3, 2) if glyphs[n]]
        plain_only = all(not k.isascii() for n in (4, 3) for k in glyphs[n])
        self.plain = [(k, glyphs[2][k]) for k in _ordered(glyphs[2]) if k.isascii()] if plain_only else None
        self.singles = str.maketrans(glyphs[1])
        self.unicode = Words()
        self.substituted = Words()

    def substitute(self, text: str) -> str:
        if self.plain is not None and text.isascii():  # all longer sequences have another character
            for key, by in self.plain:
                if key in text:
                    text = text.replace(key, by)
        else:
            for pattern, level in self.levels:
                text = pattern.sub(lambda m: level[m[0]], text)  # noqa: B023
        return text.translate(self.singles)

    def convert(self, text: str) -> str:
        """All steps behind the clean-up."""
        text = self.substitute(text)
        text = _LEADING.sub(REORDER_LEADING[1], text)
        halant = HALANT in text
        if halant:
            text = _CONJUNCT.sub(REORDER_CONJUNCT[1], text)
        text = _MARK.sub(REORDER_MARK[1], text)
        if E_SIGN in text:
            text = text.replace(E_SIGN + AA_SIGN, O_SIGN).replace(E_SIGN + AU_TAIL, AU_SIGN)
        if halant and RA + HALANT in text:
            text = _REPH.sub(REPH[1], text)
            text = _YA_PHALA.sub(YA_PHALA[1], text)
        return unicodedata.normalize("NFC", text)

    def words(self, words: list[str], step: Callable[[str], str], known: Words) -> list[str]:
        """Each word after a step."""
        new = [w for w in words if w not in known]
        if known and known.size + known.cost(new) > self.most:
            known.forget()
            new = words
        for plain in (True, False):  # those of ASCII go a shorter way
            some = [w for w in new if w.isascii() == plain]
            if some:
                done = step(" ".join(some)).split(" ")
                known.add(some, done if len(done) == len(some) else map(step, some))
        return [known[w] for w in words]

    def column(self, texts: pa.Array, step: Callable[[str], str], known: Words) -> pa.Array:
        """Texts, each distinct word done once. What is held at once is several times their size, so they are pieces of columns."""
        missing = texts.is_null()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", "\n "), " ")
        words = lists.flatten().dictionary_encode()
        done = pa.array(self.words(words.dictionary.to_pylist(), step, known), pa.string()).take(words.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, done), " ")
        return pc.if_else(missing, pa.scalar(None, pa.string()), pc.replace_substring(joined, "\n ", "\n"))


def _clean(texts: pa.Array) -> pa.Array:
    """As pre_normalize()."""
    has = lambda c: pc.any(pc.match_substring(texts, c)).as_py()
    if has("\u00ad"):
        texts = pc.replace_substring(texts, "\u00ad", "")
    if has("\r"):
        texts = pc.replace_substring(pc.replace_substring_regex(texts, _RETURNS, "\\1\n"), "\r", "")
    return pc.replace_substring(texts, "\u00a0", " ") if has("\u00a0") else texts


_CONVERTERS: dict[str, Converter] = {}


def converter(encoding: str = "bijoy", glyphs: dict[int, dict[str, str]] | None = None) -> Converter:
    """The process's converter of an encoding."""
    if encoding not in _CONVERTERS:
        _CONVERTERS[encoding] = Converter(glyphs or tables.glyphs(encoding))
    return _CONVERTERS[encoding]


def text_to_unicode(text: str) -> str:
    return to_unicode(pa.array([text], pa.string()))[0].as_py()


def to_unicode(texts: pa.Array, encoding: str = "bijoy", glyphs: dict[int, dict[str, str]] | None = None) -> pa.Array:
    one = converter(encoding, glyphs)
    return by_pieces(lambda piece: one.column(_clean(piece), one.convert, one.unicode), texts)


@F.arrow_udf(StringType())
def substitute_fast(text: pa.Array) -> pa.Array:
    """As substitute()."""
    one = converter()
    return by_pieces(lambda piece: one.column(pc.replace_substring(piece, "\u00ad", ""), one.substitute, one.substituted), text)


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode normalisation form C, which Spark has no function for."""
    return by_pieces(lambda piece: pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in piece.to_pylist()], pa.string()), text)


def transliterate(text: Column | str, encoding: str = "bijoy") -> Column:
    """Glyphs to Unicode, all steps."""
    return transliterator(encoding)(text)


@cache
def transliterator(encoding: str = "bijoy") -> Callable[[Column | str], Column]:
    """The function of an encoding, which takes its glyphs along."""
    glyphs = None if tables.ENCODINGS[encoding].file else tables.glyphs(encoding)

    @F.arrow_udf(StringType())
    def transliterate(text: pa.Array) -> pa.Array:
        return to_unicode(text, encoding, glyphs)

    return transliterate


def transliterate_native(text: Column) -> Column:
    """As transliterate(), but all in built-in functions up to the last step."""
    return nfc(post_passes(substitute(pre_normalize(text))))


def transliterate_with_audit(text: Column) -> Column:
    """STRUCT<text, spans>: one span from all bytes of the source to all of the result."""
    done = transliterate(text)
    zero = F.lit(0).cast("long")
    span = F.struct(zero.alias("source_start"), F.octet_length(text).cast("long").alias("source_end"), zero.alias("target_start"), F.octet_length(done).cast("long").alias("target_end"))
    return F.struct(done.alias("text"), F.array(span).alias("spans"))
