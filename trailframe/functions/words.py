"""Word tokens by the published Treebank rules, as a chain of replacements that Spark's expressions evaluate."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Treebank rules (pattern, replacement) in their order: opening quotes, punctuation, brackets and dashes,
#: closing quotes, contractions. They hold for lower and upper case alike.
RULES = (
    (r"([«“‘„]|[`]+)", " $1 "),
    (r'^"', "``"),
    (r"(``)", " $1 "),
    (r"([ (\[{<])(\"|'{2})", "$1 `` "),
    (r"(')([0-9_A-CE-LO-RU-Za-ce-lo-ru-z])\b", "$1 $2"),
    (r"([^.])(\.)([\])}>\"'»”’ ]*)\s*$", "$1 $2 $3 "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&])", " $1 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([*])", " $1 "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"(--)", " $1 "),
    (r"([»”’])", " $1 "),
    (r"('')", " $1 "),
    (r'(")', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", " $1 $2 "),
    (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(gim)(me)\b", " $1 $2 "),
    (r"(?i)\b(gon)(na)\b", " $1 $2 "),
    (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(lem)(me)\b", " $1 $2 "),
    (r"(?i)\b(more)('n)\b", " $1 $2 "),
    (r"(?i)\b(wan)(na)\b", " $1 $2 "),
    (r"(?i) ('t)(is)\b", " $1 $2 "),
    (r"(?i) ('t)(was)\b", " $1 $2 "),
)
#: A blank stands before and after the text from this rule on.
_PADDED = 19
#: Where a sentence ends: a stop, and closing marks, before a blank; not after a single letter or a word with a stop inside.
_SENTENCE = r"((?:^|\s)(?:[^\s.]{2,}|[0-9])[.]+[\])}>\"'»”’]*|[?!]+[\])}>\"'»”’]*)\s+"
_MARK = "\u001e"


def sentences(text: Column) -> Column:
    """The sentences of a text. What ends one is told by its last word alone, so names of several letters with a stop count as ends."""
    return F.split(F.regexp_replace(F.regexp_replace(text, _MARK, " "), _SENTENCE, f"$1{_MARK}"), _MARK)


def word_tokens(text: Column) -> Column:
    """The words of a text, sentence by sentence; a null or empty text has none."""

    def of(sentence: Column) -> Column:
        chain = lambda c, rules: functools.reduce(lambda x, r: F.regexp_replace(x, F.lit(r[0]), F.lit(r[1])), rules, c)
        marked = chain(F.concat(F.lit(" "), chain(sentence, RULES[:_PADDED]), F.lit(" ")), RULES[_PADDED:])
        return F.filter(F.split(marked, r"\s+"), lambda w: w != "")

    return F.flatten(F.transform(sentences(F.coalesce(text, F.lit(""))), of))
