"""Words on a scanned page: those under a mark, the ink that a run of words sits on, the word at a place."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, let

# How much of a word must be inside a mark, and how much of its height two words on one line share.
MOSTLY_INSIDE, ONE_LINE = 0.6, 0.5


def _side(low: Column, high: Column) -> Column:
    return F.greatest(high - low, F.lit(0.0))


def words_under(words: DataFrame, marks: DataFrame, page: str, share: float = MOSTLY_INSIDE) -> DataFrame:
    """(page, mark, word) for words (page, word, x0, y0, x1, y1) of which a mark's rectangles (page, mark, x0, y0, x1, y1) cover most; a word counts once for a mark. Words without ink are under none."""
    m = marks.select(page, "mark", *(F.col(c).alias(f"m{c}") for c in ("x0", "y0", "x1", "y1")))
    both = _side(F.greatest("x0", "mx0"), F.least("x1", "mx1")) * _side(F.greatest("y0", "my0"), F.least("y1", "my1"))
    ink = _side(F.col("x0"), F.col("x1")) * _side(F.col("y0"), F.col("y1"))
    return words.join(m, page).where((ink > 0) & (both >= ink * share)).select(page, "mark", "word").distinct()


def ink_of(words: DataFrame, page: str, share: float = ONE_LINE) -> DataFrame:
    """(page, line, x0, y0, x1, y1, words) for a run of words (page, word, x0, y0, x1, y1) on each page: a rectangle a line, not one for the run. A word is on the line before
    it if they share ``share`` of its height. A fold over a page's words in order; what a page holds bounds it."""
    box = "array<struct<x0: double, y0: double, x1: double, y1: double, words: int>>"
    run = words.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("word", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))))).alias("ws"))
    same = f"size(a) > 0 AND greatest(least(element_at(a, -1).y1, w.y1) - greatest(element_at(a, -1).y0, w.y0), 0D) >= {share}D * greatest(w.y1 - w.y0, 1e-9D)"
    wider = """concat(slice(a, 1, size(a) - 1), array(named_struct('x0', least(element_at(a, -1).x0, w.x0), 'y0', least(element_at(a, -1).y0, w.y0), 'x1', greatest(element_at(a, -1).x1, w.x1),
        'y1', greatest(element_at(a, -1).y1, w.y1), 'words', element_at(a, -1).words + 1)))"""
    new = "concat(a, array(named_struct('x0', w.x0, 'y0', w.y0, 'x1', w.x1, 'y1', w.y1, 'words', 1)))"
    lines = F.expr(f"aggregate(ws, CAST(array() AS {box}), (a, w) -> CASE WHEN {same} THEN {wider} ELSE {new} END)")
    return run.select(page, F.posexplode(lines).alias("line", "b")).select(page, "line", "b.*")


def word_at(line: Column, at: Column) -> Column:
    """(begin, end, word) of the word that holds the character at a place (from 0); null between words and outside the line."""
    head, tail = F.substring(line, F.lit(1), at), F.substring(line, at + 1, F.length(line))

    def joined(p: Column) -> Column:
        return F.when((F.length(p["b"]) > 0), F.struct((at - F.length(p["a"])).cast("int").alias("begin"), (at + F.length(p["b"])).cast("int").alias("end"), F.concat(p["a"], p["b"]).alias("word")))

    return F.when((at >= 0) & (at < F.length(line)), let(F.struct(F.regexp_extract(head, f"({WORD})$", 1).alias("a"), F.regexp_extract(tail, f"^({WORD})", 1).alias("b")), joined))


# A gap wider than this share of a glyph's height parts words, and glyphs that share this share of the lower one's height are on a line.
ONE_WORD, GLYPHS_ON_LINE = 0.28, 0.35


def grouped_words(glyphs: DataFrame, page: str) -> DataFrame:
    """(page, no, line, text, x0, y0, x1, y1, refused) of glyphs (page, no, text, x0, y0, x1, y1; y grows downwards): lines by shared height, right to left in a line, words parted by wide gaps; a word without a Hebrew letter reads
    from left to right. Control characters are what a file could not name: a glyph of these alone is left out, and a line with a glyph that holds some beside letters is refused, which its words say. What a page holds is worked through at once, in Python."""
    cols = ("x0", "y0", "x1", "y1")
    held = glyphs.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("no", "text", *(F.col(c).cast("double").alias(c) for c in cols)))).alias("g"))

    @F.pandas_udf("array<struct<line: int, text: string, x0: double, y0: double, x1: double, y1: double, refused: boolean>>")
    def run(text: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([_words_of(list(zip(*p, strict=True))) for p in zip(text, x0, y0, x1, y1, strict=True)])

    words = held.select(page, F.posexplode(run(*(F.col(f"g.{c}") for c in ("text", *cols)))).alias("no", "w"))
    return words.select(page, "no", "w.*")


_UNNAMED = re.compile("[\x00-\x1f\x7f-\x9f\ufffd]")


def _words_of(glyphs: list[tuple]) -> list[dict]:
    """The words of one page's glyphs (text, x0, y0, x1, y1)."""
    lines: list[list[tuple]] = []
    for text, x0, y0, x1, y1 in glyphs:
        drawn = _UNNAMED.sub("", text or "")
        if not drawn.strip():
            continue
        for line in lines:
            _, _, top, _, bottom, _ = line[0]
            least = min(bottom - top, y1 - y0)
            if least > 0 and min(bottom, y1) - max(top, y0) > GLYPHS_ON_LINE * least:
                break
        else:
            lines.append(line := [])
        line.append((drawn, x0, y0, x1, y1, drawn != text))
    out = []
    for n, line in enumerate(sorted(lines, key=lambda x: min(g[2] for g in x))):
        wide = sorted(g[3] - g[1] for g in line if g[3] > g[1])
        usual = wide[len(wide) // 2] if wide else 0.0
        line = sorted(((t, a, b, c if c > a else a + usual, d, odd) for t, a, b, c, d, odd in line), key=lambda g: -g[3])
        words: list[list[tuple]] = []
        for g in line:
            last = words[-1][-1] if words else None
            if last is None or last[1] - g[3] > ONE_WORD * max(last[4] - last[2], g[4] - g[2], 1e-9):
                words.append([])
            words[-1].append(g)
        refused = any(g[5] for g in line)
        for w in words:
            hebrew = any("א" <= c <= "ת" for g in w for c in g[0])
            said = "".join(g[0] for g in (w if hebrew else sorted(w, key=lambda g: g[1])))
            box = {"x0": min(g[1] for g in w), "y0": min(g[2] for g in w), "x1": max(g[3] for g in w), "y1": max(g[4] for g in w)}
            out += [{"line": n, "text": t, **box, "refused": refused} for t in said.split()]
    return out


def stranded(fixes: DataFrame, words: DataFrame, page: str) -> DataFrame:
    """Fixes of read words (page, mark, was, x0, y0, x1, y1) that find no word any more: none under their ink says what they corrected. ``mark`` names a fix."""
    under = words_under(words, fixes, page).join(words.select(page, "word", F.col("text").alias("was")).distinct(), [page, "word"])
    return fixes.join(under.select(page, "mark", "was").distinct(), [page, "mark", "was"], "left_anti")


def pages_left(pages: DataFrame, read: DataFrame, page: str, engine: str) -> DataFrame:
    """The pages that an engine has not read (page, engine); what is read is the only record, so a job that stopped goes on."""
    return pages.join(read.where(F.col("engine") == engine).select(page), page, "left_anti")
