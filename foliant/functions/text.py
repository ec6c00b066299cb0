"""Text scalars as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of the Latin profile.
WORD = r"[\p{L}\p{N}]+"
# Hebrew letters in order with their sums, final forms and what they fold to, quote signs.
HEBREW, HEBREW_VALUES = "אבגדהוזחטיכלמנסעפצקרשת", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400]
FINALS, FOLDED = "ךםןףץ", "כמנפצ"
LATIN = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it: the optimizer copies an expression into each of its uses, but not a lambda's variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """The words of a text in order, in lower case; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def hebrew_normal(text: Column) -> Column:
    """Marks deleted, quote signs made plain, final letters folded; applying it twice changes nothing more."""
    bare = F.regexp_replace(text, "[֑-ֽֿׁ-ׂׄ-ׇׅ]", "")
    return F.translate(F.translate(bare, "׳’‘״“”", "'''\"\"\""), FINALS, FOLDED)


def letter_value(word: Column, letters: str = LATIN, values: list[int] | None = None) -> Column:
    """The sum of the letters' values; null if any character is no letter of the table, or for an empty word."""
    values = values or [i + 1 for i in range(len(letters))]
    table = F.create_map(*(F.lit(x) for pair in zip(letters, values, strict=True) for x in pair))
    parts = F.filter(F.split(word, ""), lambda c: c != "")
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("long"), lambda a, c: a + F.try_element_at(table, c)))


def mirrored(word: Column, letters: str = LATIN) -> Column:
    """The first letter for the last and so on."""
    return F.translate(word, letters, letters[::-1])


def initials_at(words: Column, wanted: str, last: bool = False) -> Column:
    """Where (from 0) a run of words begins whose first, or last, letters spell ``wanted``."""
    k = len(wanted)

    def found(letters: Column) -> Column:
        starts = F.when(F.size(letters) >= k, F.sequence(F.lit(0), F.size(letters) - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(starts, lambda i: F.array_join(F.slice(letters, i + 1, k), "") == wanted)

    return let(F.transform(words, lambda w: F.right(w, F.lit(1)) if last else F.left(w, F.lit(1))), found)


def snippet(text: Column, at: Column, length: Column, width: int = 220) -> Column:
    """A window of ``width`` characters around the mark at ``at`` (from 0), a quarter of it before; the mark in brackets; dots where text is left out."""
    begin = F.greatest(at - width // 4, F.lit(0))
    end = F.least(begin + width, F.length(text))
    mark_end = F.least(at + length, end)
    return F.concat(
        F.when(begin > 0, "…").otherwise(""), F.substring(text, begin + 1, at - begin), F.lit("["), F.substring(text, at + 1, mark_end - at), F.lit("]"),
        F.substring(text, mark_end + 1, end - mark_end), F.when(end < F.length(text), "…").otherwise(""),
    )


def opening(text: Column, n: int = 90) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def fixed_day(date: Column) -> Column:
    """Days from 1 January of the year 1 (which is 1) by the civil calendar carried backwards."""
    return F.unix_date(date.cast("date")).cast("long") + 719163


def era_order(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """before, after, contemporary or unknown, by inclusive ranges of years."""
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(~known, "unknown").when(a1 < b0, "before").when(a0 > b1, "after").otherwise("contemporary")


def edge_type(label: Column) -> Column:
    name = F.lower(label)
    return F.when(name.isin("commentary", "targum"), "comments-on").when(name == "quotation", "quotes").when(name.isin("midrash", "allusion"), "paraphrases").otherwise("references")


def confidence(method: Column, directed: Column, verdict: Column) -> Column:
    """Cited 0.9, inferred 0.7, drawn by the user 1; 0.15 less without a declared direction; a verdict overrules."""
    base = F.when(method == "cited", 0.9).when(method == "mine", 1.0).otherwise(0.7) - F.when(directed, 0.0).otherwise(0.15)
    return F.round(F.when(verdict == "rejected", 0.0).when((verdict == "confirmed") | (method == "mine"), 1.0).otherwise(base), 4)


def located(text: Column, begin: Column, was: Column) -> Column:
    """Where a patch applies: at its own place, else at the only other occurrence, else nowhere (null). Occurrences that overlap count."""
    first = F.call_function("locate", was, text)
    again = F.call_function("locate", was, text, first + 1)
    return F.when(F.substring(text, begin + 1, F.length(was)) == was, begin).when((first > 0) & (again == 0), first - 1)


# The words with which a question opens.
ASKING = ["מה", "ומה", "מהו", "מהי", "מי", "ומי", "מיהו", "מיהי", "מתי", "למה", "מדוע", "כיצד", "איך", "האם", "היכן", "מהיכן", "איפה", "לאן", "כמה", "מנין", "מניין", "מאין", "what", "who", "when", "why", "how"]


def is_question(text: Column) -> Column:
    """Whether a text has a question mark or opens with a word that asks; null is none."""
    first = F.lower(F.regexp_extract(text, f"({WORD})", 1))
    return F.coalesce(text.rlike("[?؟]") | first.isin(*ASKING), F.lit(False))
