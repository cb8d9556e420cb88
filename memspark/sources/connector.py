"""The contract of a connector: connect, fetch, normalise, diff and sync, over one source and one corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.ids import bronze_id, content_hash
from memspark.sources.exports import Profile, profile, read_source
from memspark.store import Corpus


@dataclass(frozen=True)
class Connector:
    """An export of one kind at a path, and the corpus that it feeds."""

    corpus: Corpus
    path: str
    kind: str
    redaction: str = "off"

    @property
    def profile(self) -> Profile:
        return profile(self.kind)

    def connect(self) -> dict:
        """What the source is; an unknown kind or a missing path is an error."""
        self.fetch()
        return {"name": self.profile.name, "source_type": self.profile.source_type, "mode": self.profile.mode, "features": list(self.profile.features), "path": self.path}

    def fetch(self) -> DataFrame:
        return read_source(self.corpus.spark, self.path, self.kind, self.redaction)

    def normalize(self) -> DataFrame:
        """The rows as chunks, with their ids and hashes."""
        return self.fetch().withColumns({"id": bronze_id(F.col("content")), "content_hash": content_hash(F.col("content")), "corpus_id": F.lit(self.corpus.corpus_id)})

    def diff(self) -> DataFrame:
        return self.corpus.connector_diff(self.path, self.kind)

    def sync(self, deactivate_removed: bool = False) -> DataFrame:
        return self.corpus.sync(self.path, self.kind, deactivate_removed)
