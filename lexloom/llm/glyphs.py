"""Tables of characters that look alike, made from the Unicode database and a few fixed values."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin or a Russian letter. Same place, same look.
LATIN_LIKE = "aceopxyABCEHKMOPTX"
RUSSIAN_LIKE = "асеорхуАВСЕНКМОРТХ"
# Letters outside the Russian alphabet and Greek ones, with the Latin and the Russian letter they look like ("" if none).
FOREIGN = {
    "ѕ": ("s", ""), "і": ("i", ""), "ј": ("j", ""), "Ѕ": ("S", ""), "І": ("I", ""), "Ј": ("J", ""), "һ": ("h", ""), "ԁ": ("d", ""),
    "ο": ("o", "о"), "Ο": ("O", "О"), "Α": ("A", "А"), "Β": ("B", "В"), "Ε": ("E", "Е"), "Ζ": ("Z", ""), "Η": ("H", "Н"), "Ι": ("I", ""),
    "Κ": ("K", "К"), "Μ": ("M", "М"), "Ν": ("N", ""), "Ρ": ("P", "Р"), "Τ": ("T", "Т"), "Υ": ("Y", ""), "Χ": ("X", "Х"), "Γ": ("", "Г"),
    "Φ": ("", "Ф"), "α": ("a", "а"), "ρ": ("p", "р"), "ν": ("v", ""), "ε": ("", "е"), "υ": ("u", ""), "χ": ("x", "х"), "ı": ("i", ""),
}
# Letters of further scripts, Latin ones of other alphabets among them, that look like a Latin letter, in pairs; each looks like the
# Russian letter that its Latin one looks like, if there is one.
ALSO_LATIN = (
    "ԛq ԝw ԜW ԚQ ԌG ɑa ɡg ϲc ϳj ϹC օo հh յj ցg ոn սu ՕO ՏS ՍU ᎪA ᏴB ᏟC ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᎳW ᏃZ ᎠD ᎡR "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲀA ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT ⲬX ᴏo ᴄc ᴠv ᴡw ᴢz ꜱs"
).split()
HYPHENS = "\u2010\u2011\u2043\u02d7\ufe63\uff0d"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def single() -> dict[str, str]:
    """Character -> what it decomposes to, without regard to script: full-width forms to ordinary ones, letters to
    base and marks, hyphens to the ordinary one, special blanks to a blank, invisible characters to nothing.

    A rule over all of Unicode: canonical decompositions, and compatibility ones that only change the width or are
    ligatures of letters; format characters vanish. Signs whose replacement looks different are not in it."""
    out: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        kind = unicodedata.decomposition(c)
        if c in HYPHENS:
            out[c] = "-"
        elif c in BLANKS:
            out[c] = " "
        elif unicodedata.category(c) == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            out[c] = ""
        elif kind.startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB06:
            out[c] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
        elif kind and not kind.startswith("<"):
            d = unicodedata.normalize("NFD", c)
            if d != c:
                out[c] = d
    return out


@lru_cache(maxsize=1)
def marks() -> dict[str, int]:
    """Combining mark -> its class."""
    return {chr(c): k for c in range(sys.maxunicode + 1) if (k := unicodedata.combining(chr(c)))}


@lru_cache(maxsize=1)
def scripts() -> dict[str, tuple[str, str, str]]:
    """Letter -> (script it shows beyond doubt, L, R or nothing; how it looks in Latin; how it looks in Russian)."""
    out: dict[str, tuple[str, str, str]] = {}
    for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)]):
        out[c] = ("L", c, c)
    for c in "абвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ":
        out[c] = ("R", c, c)
    for a, b in zip(LATIN_LIKE, RUSSIAN_LIKE, strict=True):
        out[a], out[b] = ("", a, b), ("", a, b)
    for c, (a, b) in FOREIGN.items():
        out[c] = ("", a or c, b or c)
    russian = dict(zip(LATIN_LIKE, RUSSIAN_LIKE, strict=True))
    for c, a in ALSO_LATIN:
        out[c] = ("", a, russian.get(a, c))
    return out


def plain_word(word: str | None) -> str | None:
    """The plain form of one word, the slow and obvious way; the operator must give the same."""
    if word is None:
        return None
    one, look = single(), scripts()
    flat = "".join(one.get(c, c) for c in word)
    pieces = []
    for piece in re.split("(-)", flat):
        seen = {look[c][0] for c in piece if c in look} - {""}
        if seen == {"L"}:
            piece = "".join(look[c][1] if c in look else c for c in piece)
        elif seen == {"R"}:
            piece = "".join(look[c][2] if c in look else c for c in piece)
        pieces.append(piece)
    return unicodedata.normalize("NFC", "".join(pieces)).strip(" ")


@lru_cache(maxsize=1)
def _folding() -> dict[int, str]:
    out = {}
    for c, d in single().items():
        out[ord(c)] = "".join(x for x in d if not unicodedata.combining(x)) if len(d) > 1 else d
    for c in marks():
        out[ord(c)] = ""
    for c, (_, a, _) in scripts().items():
        if a != c:
            out[ord(c)] = a
    for c, d in list(out.items()):
        out[c] = "".join(scripts()[x][1] if x in scripts() else x for x in d)
    # After case folding: small letters whose capitals look alike.
    return out


@lru_cache(maxsize=1)
def _small() -> dict[int, str]:
    # After lower-casing, small letters of capitals that look alike (В/B, Н/H, К/K, М/M, Т/T) or don't (У).
    return str.maketrans("внкмту", "bhkmty")


def folding() -> tuple[dict[str, str], dict[str, str]]:
    """What skeleton replaces before it lower-cases: characters by one or none, and the few by several."""
    table = {chr(c): d for c, d in _folding().items() if chr(c) != d}
    return {c: d for c, d in table.items() if len(d) < 2}, {c: d for c, d in table.items() if len(d) > 1}


def small() -> dict[str, str]:
    """What skeleton replaces after it has lower-cased."""
    return {chr(c): chr(d) for c, d in _small().items()}


def skeleton(text: str) -> str:
    """A form in which texts that differ in case, marks (so ё = е), width, invisible or look-alike characters are equal.

    Not for display: Russian letters that resemble Latin ones become those."""
    return text.translate(_folding()).lower().translate(_small())
