"""The tables that the functions rest on: glyphs, fonts, words. Read once, on first use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from importlib.resources import files

#: Glyphs that make text look legacy-encoded, and pairs of a letter and a vowel sign.
DISTINCTIVE = "¡¢£¥¦§©ª«¬®¯µ¶·¸»¼½¾ÀÁÂÃÄÅÆÇÈÉÊËÌÏ×ØÙÚÛÜÞßàáâãäåçéêëìíîïðòóôõö÷ùûüýþŒŠš—†‡•‰‹›"
AA_SIGN = "ABKMNPRSTYZabcdefghijklmnpq"  # each before v
I_SIGN = "KMPQRZabcdefghijklmnpq"  # each after w
E_SIGN = "KLMNPQRSTUVWXYZbcdefghijklmnpq"  # each after ‡
PARTICLES = ("Aviv", "Ges", "Zviv", "wQj")


def pairs() -> list[str]:
    """All patterns that count as hits."""
    return [c + "v" for c in AA_SIGN] + ["w" + c for c in I_SIGN] + ["‡" + c for c in E_SIGN] + list(PARTICLES)


def _lines(name: str) -> list[str]:
    text = files("glyphlake").joinpath("data", name).read_text("utf-8")
    return [line for line in text.splitlines() if line and not line.startswith("#")]


def _text(points: str) -> str:
    return "".join(chr(int(p, 16)) for p in points.split("."))


@dataclass(frozen=True)
class Encoding:
    """A legacy encoding: its name, other names for it, and the file of glyphs or the pairs themselves.

    A new one is a new entry of ENCODINGS; options name it, and conversions use its glyphs.
    """

    name: str
    aliases: tuple[str, ...]
    file: str | None = None
    pairs: tuple[tuple[str, str], ...] = ()


ENCODINGS = {"bijoy": Encoding("bijoy", ("bijoy", "sutonnymj"), "glyphs.txt")}


def encoding_of(name: str | None) -> str:
    """The encoding of a name or an alias, in any case."""
    wanted = (name or "bijoy").lower()
    for encoding in ENCODINGS.values():
        if wanted in encoding.aliases:
            return encoding.name
    raise ValueError(f"unknown encoding {name!r}")


@cache
def glyphs(encoding: str = "bijoy") -> dict[int, dict[str, str]]:
    """Unicode text by glyph sequence, by the sequence's length."""
    chosen = ENCODINGS[encoding]
    pairs = [(key, text) for text, key in ((_text(x) for x in line.split(" = ")) for line in _lines(chosen.file))] if chosen.file else chosen.pairs
    out: dict[int, dict[str, str]] = {4: {}, 3: {}, 2: {}, 1: {}}
    for key, text in pairs:
        out[len(key)][key] = text
    return out


@dataclass(frozen=True)
class Family:
    stem: str
    companion: str | None
    sans: bool


@cache
def fonts() -> tuple[list[str], list[str], list[Family]]:
    """Parts of legacy font names, parts of Unicode font names, families."""
    rows = [line.split("\t") for line in _lines("fonts.txt")]
    return [r[1] for r in rows if r[0] == "legacy"], [r[1] for r in rows if r[0] == "unicode"], [Family(r[1], None if r[2] == "-" else r[2], r[3] == "s") for r in rows if r[0] == "family"]


@cache
def english() -> frozenset[str]:
    return frozenset(w for line in _lines("english.txt") for w in line.split())
