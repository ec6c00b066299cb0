"""What is searched, checked before anything runs; a search that is too broad is refused by name, never narrowed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

MOST_NEAR_WORDS, MOST_FORMS = 5, 1024
SHAPES, MATCHES = ("anywhere", "phrase", "near"), ("word", "contains", "letters", "regex", "prefix")


class Refused(ValueError):
    """A search that is not run, with the limit that it breaks."""


@dataclass(frozen=True)
class SearchPlan:
    """words[i] holds the forms of position i, any of which satisfies it."""

    words: tuple[tuple[str, ...], ...]
    shape: str = "anywhere"
    match: str = "word"
    slop: int = 0
    #: For the match ``prefix``: the letters of which one to four may stand before a word; none named, any up to four characters.
    particles: str = ""

    def __post_init__(self) -> None:
        if not self.words or not all(self.words):
            raise Refused("nothing to search for")
        if self.shape not in SHAPES or self.match not in MATCHES:
            raise Refused(f"no such shape or match: {self.shape}, {self.match}")
        if self.shape == "near" and len(self.words) > MOST_NEAR_WORDS:
            raise Refused(f"more than {MOST_NEAR_WORDS} words in any order")
        forms = 1
        for w in self.words:
            forms *= len(w)
        if self.shape == "phrase" and forms > MOST_FORMS:
            raise Refused(f"more than {MOST_FORMS} exact sequences")
        if self.match == "regex":
            if self.shape == "near":
                raise Refused("a pattern has no neighbours")
            for w in self.words:
                for p in w:
                    if not p or p[0] == "^" or p[-1] == "$" or re.search(r"\(\?[=!<]|\\[1-9]", p):
                        raise Refused(f"a pattern covers a whole word, without anchors, look-around or references: {p!r}")

    def term(self, x: Column, forms: tuple[str, ...]) -> Column:
        """Whether a word satisfies a position."""
        one = {
            "word": lambda f: x == f, "contains": lambda f: x.contains(f), "regex": lambda f: x.rlike(f"^(?:{f})$"),
            "letters": lambda f: x.rlike("^.*" + ".*".join(map(re.escape, f)) + ".*$"), "prefix": lambda f: x.rlike(f"^[{re.escape(self.particles)}]{{1,4}}{re.escape(f)}$" if self.particles else f"^.{{0,4}}{re.escape(f)}$"),
        }[self.match]
        out = one(forms[0])
        for f in forms[1:]:
            out = out | one(f)
        return out

    def _takes(self, forms: tuple[str, ...], words: Column | None = None) -> Callable[[Column], Column]:
        """A test of a word, or of a place in ``words``."""
        return lambda x: self.term(x if words is None else F.get(words, x), forms)

    def gate(self, text: Column) -> Column:
        """A cheap test of the lower-case text that every hit passes; it spares the others being cut into words."""
        out = F.lit(True)
        if self.match in ("word", "contains", "prefix"):
            for forms in self.words:
                any_ = F.lit(False)
                for f in forms:
                    any_ = any_ | text.contains(f)
                out = out & any_
        return out

    def matches(self, words: Column) -> Column:
        """Whether a segment, as an array of words, is a hit."""
        return let(words, self._matches)

    def _matches(self, words: Column) -> Column:
        k = len(self.words)
        if self.shape == "anywhere" or k == 1:
            out = F.lit(True)
            for forms in self.words:
                out = out & F.exists(words, self._takes(forms))
            return out
        if self.shape == "phrase":
            starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))

            def here(i: Column) -> Column:
                out = F.lit(True)
                for n, forms in enumerate(self.words):
                    out = out & self.term(F.get(words, i + n), forms)
                return out

            return F.exists(starts, here)
        places = F.array(*(F.filter(F.transform(words, lambda x, i: i), self._takes(forms, words)) for forms in self.words))

        def nested(n: int, got: list[Column], places: Column) -> Column:
            if n == k:
                apart = F.lit(True)
                for a in range(k):
                    for b in range(a):
                        apart = apart & (got[a] != got[b])
                return apart & (F.greatest(*got) - F.least(*got) + 1 - k <= self.slop)
            return F.exists(F.get(places, F.lit(n)), lambda i: nested(n + 1, [*got, i], places))

        return let(places, lambda p: nested(0, [], p))


def read_sigils(typed: str) -> SearchPlan:
    """``/re/`` a pattern, ``"a b"`` a phrase, ``~n a b`` near, ``*a*`` contains, ``~w`` letters in order; else all words anywhere."""
    t = typed.strip()
    if len(t) > 1 and t[0] == t[-1] == "/":
        return SearchPlan(tuple((p,) for p in t[1:-1].split()), match="regex")
    if m := re.match(r"~(\d+)\s+(.+)$", t):
        return replace(read_sigils(m[2]), shape="near", slop=int(m[1]))
    if len(t) > 1 and t[0] == t[-1] == '"':
        return SearchPlan(_words(t), shape="phrase")
    if len(t) > 2 and t[0] == t[-1] == "*":
        return SearchPlan(_words(t), match="contains")
    if t.startswith("~"):
        return SearchPlan(_words(t), match="letters")
    return SearchPlan(_words(t))


def _words(t: str) -> tuple[tuple[str, ...], ...]:
    import regex

    return tuple((w,) for w in regex.findall(r"[\p{L}\p{N}]+", t.lower()))
