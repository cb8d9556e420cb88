"""Retrieval behind one interface: the corpus's tables, or vectors of its chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.config import Settings
from memspark.operators import recall
from memspark.store import Corpus


class Backend(Protocol):
    def search(self, text: str, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Tables:
    """Search by words in documents, timeline, nodes and edges."""

    corpus: Corpus

    def search(self, text: str, k: int = 20) -> DataFrame:
        return self.corpus.query(text, k)


@dataclass(frozen=True)
class Vectors:
    """The active chunks nearest to a text by cosine. ``vectors`` has id and embedding; ``embed`` gives a text's own vector."""

    corpus: Corpus
    vectors: DataFrame
    embed: Callable[[str], list[float]]

    def search(self, text: str, k: int = 20) -> DataFrame:
        asked = self.corpus.spark.createDataFrame([("", self.embed(text))], "id string, embedding array<double>")
        live = self.vectors.join(self.corpus.documents().select("id"), "id", "left_semi")
        return recall.nearest(live, "id", "embedding", asked, k).select(F.col("rn").cast("long").alias("rank"), F.col("key").alias("id"), "similarity")


def backend(corpus: Corpus, settings: Settings, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None) -> Backend:
    """The backend that the settings ask for; vectors need a table and an embedding function."""
    has = vectors is not None and embed is not None
    if settings.retrieval(has) == "vectors":
        if not has:
            raise ValueError("the vectors backend needs vectors and an embedding function")
        return Vectors(corpus, vectors, embed)
    return Tables(corpus)
