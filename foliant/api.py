"""The public calls: one for each read tool, each giving a DataFrame, over tables that the caller has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, index, places, records, search, shelf
from .plans.search_plan import read_sigils


@dataclass
class Library:
    """segments (doc_id, line_no, source, lang, line), works, edges (edge_no, src_work, src_ord, dst_work, dst_ord, edge_type, type_no, confidence), timeline (node, y0, y1), addresses (work, address, ord), vectors."""

    segments: DataFrame
    works: DataFrame | None = None
    edges: DataFrame | None = None
    timeline: DataFrame | None = None
    addresses: DataFrame | None = None
    vectors: DataFrame | None = None

    def _need(self, name: str) -> DataFrame:
        if (got := getattr(self, name)) is None:
            raise LookupError(f"{name} has not been built")
        return got

    def search(self, typed: str) -> DataFrame:
        return search.hits(self.segments, read_sigils(typed))

    def read(self, doc_id: int, line_no: int, around: int = 0) -> DataFrame:
        at = (F.col("doc_id") == doc_id) & (F.col("line_no") == line_no)
        return search.around(self.segments.where(F.col("doc_id") == doc_id), "doc_id", "line_no", at, min(max(around, 0), 20))

    def resolve(self, asked: DataFrame) -> DataFrame:
        return places.resolve(asked, self._need("addresses"))

    def where_from(self, phrases: DataFrame, n_words: int = 4, without: str | None = None) -> DataFrame:
        return search.where_from(self.segments, phrases, n_words, without=without)

    def links(self, work: str, lo: int, hi: int) -> DataFrame:
        e = graph.inverted(self._need("edges"))
        return e.where((F.col("work") == work) & F.col("ord").between(lo, hi))

    def _graph(self) -> DataFrame:
        return self._need("edges").select("edge_no", F.col("src_work").alias("a"), F.col("dst_work").alias("b"), "type_no", "confidence")

    def trace(self, start: str, back: bool = True, depth: int = 3, width: int = 8) -> tuple[DataFrame, dict[str, int]]:
        return graph.trace(self._graph(), self._need("timeline"), start, back, depth, width)

    def path(self, start: str, end: str, most: int = 12) -> DataFrame:
        return graph.path(self._graph(), start, end, most)

    def path_steps(self, start: str, end: str, most: int = 12) -> DataFrame:
        return graph.path_steps(self._graph(), start, end, most)

    def build(self, path: str, batch: str = "0") -> None:
        """Writes the index that ``search_built`` reads."""
        index.write(self.segments, path, batch)

    def search_built(self, typed: str, path: str, broad: bool = False) -> DataFrame:
        return index.search(self.segments.sparkSession, path, read_sigils(typed), broad=broad)

    def suggest(self, typed: str, title: str = "title") -> DataFrame:
        return shelf.suggestions(self._need("works"), title, typed)

    def chains(self, start: str, back: bool = True, depth: int = 3, width: int = 8) -> DataFrame:
        steps = graph.cut(self.trace(start, back, depth, width)[0], "chain-steps")
        return shelf.chains(steps, self._graph(), start, depth)

    def fork(self, start: str) -> DataFrame:
        return graph.forks(self._graph(), start)

    def adjacent(self, query: list[float], k: int = 10) -> DataFrame:
        """Never part of a literal answer."""
        return records.nearest_shortlisted(self._need("vectors"), query, k)

    def catalogue(self, typed: str | None = None, title: str = "title") -> DataFrame:
        works = self._need("works")
        return works if typed is None else search.title_rank(works, typed, title)
