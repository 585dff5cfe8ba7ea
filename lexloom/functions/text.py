"""Column expressions for text: tokens, sentences, word types, cleaning. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a language: words with inner hyphens (and U+2032 in Russian), runs of terminators, any other sign alone.
TOKEN = {
    "ru": r"[\p{L}\p{N}]+(?:[-′][\p{L}\p{N}]+)*|[.!?…]+|[^\s\p{L}\p{N}]",
    "en": r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|'[\p{L}]+|[^\s\p{L}\p{N}]",
}
#: Where a sentence ends in a paragraph: terminators, closing marks, blanks.
SENTENCE_END = "([.!?…]+[\"”»)]*\\s+)"
# Characters of a Russian and of an English word, and punctuation.
RU_WORD, EN_WORD, PUNCT = "^[а-яА-ЯёЁ′-]*[а-яА-ЯёЁ][а-яА-ЯёЁ′-]*$", "^[a-zA-Z'-]*[a-zA-Z][a-zA-Z'-]*$", r"^[\p{P}\p{S}]+$"
APOSTROPHES = "'’ʼ`´‘"
_MARK = "\u0001"


def paragraphs(text: Column) -> Column:
    """The lines of a text; blank lines keep their place."""
    return F.split(text, "\n")


def sentences(paragraph: Column) -> Column:
    """The sentences of a paragraph by the simple rule; empty ones are left out."""
    marked = F.regexp_replace(paragraph, SENTENCE_END, "$1" + _MARK)
    return F.filter(F.split(marked, _MARK), lambda s: F.trim(s) != "")


def token_pieces(text: Column, language: str = "ru") -> Column:
    """Tokens with the blanks that follow each."""
    return F.regexp_extract_all(text, F.lit(f"(?:{TOKEN[language]})\\s*"), F.lit(0))


def bare(piece: Column) -> Column:
    return F.regexp_replace(piece, "\\s+$", "")


def word_type(word: Column, language: str = "ru") -> Column:
    """punct, the language, or unk."""
    return F.when(word.rlike(PUNCT), "punct").when(word.rlike(RU_WORD if language == "ru" else EN_WORD), language).otherwise("unk")


def interformat_line(line: Column) -> Column:
    """Without soft hyphens; an apostrophe between Russian letters becomes U+2032."""
    flat = F.regexp_replace(line, "\u00ad", "")
    return F.regexp_replace(flat, f"(?<=[а-яА-ЯёЁ])[{APOSTROPHES}](?=[а-яА-ЯёЁ])", "′")


def yo(word: Column) -> Column:
    return F.translate(word, "ёЁ", "еЕ")


def is_capitalized(word: Column) -> Column:
    return F.lower(F.substring(word, 1, 1)) != F.substring(word, 1, 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is all zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
