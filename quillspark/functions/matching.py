"""Many lexicons against a text in one pass: the containment join of texts and terms.

A term that must stand between bounds is made of whole words of the text. So a text is cut into words once, and its
words are met with the vocabulary of all lexicons by hashing; what is left, a handful of words, answers every lexicon.
Terms of one word need nothing more. A phrase is looked for only where all of its words are there, first as a
plain substring and then, where that is found, between its bounds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What words are made of: for terms, and for patterns, whose bounds know capitals and the underscore too.
TERM, PATTERN = "a-z0-9", "A-Za-z0-9_"
_PIECE = re.compile(r"(\\s\+|\[[^\]]+\]|\\[^A-Za-z0-9]|[^\\()\[\]{}+*?.^$|])(\?)?")


class Term(NamedTuple):
    """One term: the words it is made of, and, unless it is one word, a part to look for and the pattern that decides."""

    text: str
    words: tuple[str, ...]
    part: str
    pattern: str | None


def spellings(alternative: str) -> list[list[str]]:
    """What a pattern of literals, character classes and optional characters can match, cut at \\s+.

    Other constructs have no finite list of spellings and raise ValueError.
    """
    options, at = [], 0
    while at < len(alternative):
        piece = _PIECE.match(alternative, at)
        if not piece:
            raise ValueError(f"no finite list of spellings: {alternative}")
        body, at = piece[1], piece.end()
        chars = ["\0"] if body == r"\s+" else list(body[1:-1]) if body[0] == "[" else [body[-1]]
        options.append(chars + [""] * bool(piece[2]))
    return ["".join(x).split("\0") for x in product(*options)]


def quoted(text: str) -> str:
    """A text as a literal of SQL. Long lists of literals are given as SQL: one call, where columns would take one for each."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> Column:
    """An array of literals."""
    return F.expr(f"CAST(array({', '.join(map(quoted, values))}) AS ARRAY<STRING>)")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def terms_of(alternative: str, word: str) -> list[Term]:
    """A pattern's spellings as terms; where they cannot be listed, one term that is decided by the pattern alone."""
    try:
        every = spellings(alternative)
    except ValueError:
        return [Term(alternative, (), "", rf"(?<![{word}])(?:{alternative})(?![{word}])")]
    out = []
    for parts in every:
        words = tuple(w for p in parts for w in re.findall(f"[{word}]+", p))
        plain = len(parts) == 1 and words == (parts[0],)
        pattern = None if plain else rf"(?<![{word}])" + r"\s+".join(re.escape(p) for p in parts) + rf"(?![{word}])"
        out.append(Term(alternative, words, max(parts, key=len), pattern))
    return out


class Lexicons:
    """Named lexicons: lists of literal terms, or patterns with | between alternatives.

    Texts are given in lower case. ``words`` is computed once for a text, settled in a column, and handed to the others.
    """

    def __init__(self, word: str = TERM, **lexicons: Iterable[str] | str):
        literal = lambda x: re.escape(x).replace(r"\ ", " ")
        alternatives = {name: x.split("|") if isinstance(x, str) else [literal(t) for t in x] for name, x in lexicons.items()}
        self.word = word
        self.terms = {name: [terms_of(a, word) for a in found] for name, found in alternatives.items()}
        self.shown = {name: found if isinstance(lexicons[name], str) else tuple(lexicons[name]) for name, found in alternatives.items()}
        self.vocabulary = sorted({w for groups in self.terms.values() for g in groups for t in g for w in t.words})

    def words(self, text: Column) -> Column:
        """The words of the vocabulary that a text has."""
        return F.array_intersect(F.split(text, f"[^{self.word}]+"), texts(self.vocabulary))

    def found(self, text: Column, then: Callable[[Column, Column], Column]) -> Column:
        """``then`` of the vocabulary's words and the text, each computed once, where there is no column to settle them in."""
        return let(text, lambda t: let(self.words(t), lambda w: then(w, t)))

    @staticmethod
    def _matching(terms: list[tuple[str, Term]], words: Column, text: Column) -> tuple[Column, Callable[[Column], Column]]:
        """Terms as an array of structs, and whether the text has one of them."""
        rows = [f"named_struct('shown', {quoted(shown)}, 'words', CAST(array({', '.join(map(quoted, t.words))}) AS ARRAY<STRING>), 'part', {quoted(t.part)}, 'pattern', {quoted(t.pattern or '')})" for shown, t in terms]
        has = lambda t: (F.size(F.array_except(t["words"], words)) == 0) & ((t["pattern"] == "") | F.contains(text, t["part"]) & F.rlike(text, t["pattern"]))
        return F.expr(f"array({', '.join(rows)})"), has

    def any(self, name: str, words: Column, text: Column) -> Column:
        """Whether a text has any term of a lexicon."""
        every = [t for group in self.terms[name] for t in group]
        single, phrases = [t.words[0] for t in every if t.pattern is None], [("", t) for t in every if t.pattern is not None]
        found = [F.arrays_overlap(words, texts(single))] if single else []
        if phrases:
            found.append(F.exists(*self._matching(phrases, words, text)))
        return reduce(or_, found) if found else F.lit(False)

    def which(self, name: str, words: Column, text: Column) -> Column:
        """The terms of a lexicon that a text has, in the lexicon's order."""
        every = [(shown, t) for shown, group in zip(self.shown[name], self.terms[name], strict=True) for t in group]
        if not every:
            return texts([])
        return F.array_distinct(F.transform(F.filter(*self._matching(every, words, text)), lambda t: t["shown"]))
