"""Tool surface for assistants: collection and tenant are fixed when the tools are made, never part of a call."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noteloom import deadline, index, schemas
from noteloom.operators import embedding, retrieval, security

NO_RESULTS = "No results."


@dataclass(frozen=True)
class Scope:
    collection: str
    tenant_id: str
    areas: tuple[str, ...]

    def __post_init__(self):
        if not self.tenant_id or self.collection not in schemas.COLLECTIONS:
            raise retrieval.QueryError("a scope needs a known collection and a tenant")

    def check(self, area: str = "", note_type: str = "") -> None:
        """Facets that a call may name."""
        if area and area not in self.areas:
            raise retrieval.QueryError(f"unknown area {area!r}")
        if note_type and note_type not in schemas.NOTE_TYPES:
            raise retrieval.QueryError(f"unknown type {note_type!r}")


class KnowledgeTools:
    """Tools over one state of an index, which is read anew after `refresh`."""

    def __init__(self, scope: Scope, own: index.Index, embed: Callable[[SparkSession, str], tuple] = embedding.hash_question, seconds: float = deadline.SEARCH_SECONDS):
        self._scope, self._index, self._embed, self._seconds = scope, own, embed, seconds
        self.refresh()

    def refresh(self) -> None:
        self._state = self._index.current()
        self._points = self._index.points(self._state, self._scope.tenant_id)

    def search_knowledge(self, text: str, top_k: int | None = None, area: str = "", note_type: str = "", tags: Sequence[str] = ()) -> str:
        """Framed results, best first; an empty answer says whether the area itself is empty. A search that takes longer than
        it may is cancelled."""
        self._scope.check(area, note_type)
        asked = retrieval.Query(self._scope.collection, self._scope.tenant_id, text, top_k=retrieval.clamp_top_k(top_k), area=area, type=note_type, tags=tuple(tags)).validate()
        return deadline.within(self._index.spark, self._seconds, lambda: self._search(asked, text, area))

    def _search(self, asked: retrieval.Query, text: str, area: str) -> str:
        rows = retrieval.format_results(self._index.ask(asked, *self._embed(self._index.spark, text), self._state))
        rows = rows.withColumn("path_error", security.path_error(F.col("path")))
        block = security.render_block(F.col("path"), F.col("title"), F.col("breadcrumb"), F.col("uid"), F.col("chunk_index"), F.col("score"), F.col("text"))
        found = rows.select("position", "error", "path_error", block.alias("block")).orderBy("position").collect()
        for r in found:
            if r.error or r.path_error:
                raise ValueError(r.error or f"result {r.position}: path {r.path_error}")
        if not found and retrieval.is_dead_area(self._points, asked):
            return f"{NO_RESULTS} The area {area!r} holds no notes."
        return "\n\n".join(r.block for r in found) or NO_RESULTS

    def get_note(self, uid: str) -> str:
        """All chunks of a note, framed; from 64 chunks on it is too large."""
        asked = retrieval.Query(self._scope.collection, self._scope.tenant_id, uid=uid)
        rows = retrieval.get_note(self._points, replace(asked, text="")).limit(retrieval.MANY_CHUNKS).collect()
        if len(rows) >= retrieval.MANY_CHUNKS:
            raise ValueError(f"note {uid} is too large")
        if not rows:
            return NO_RESULTS
        spark = self._points.sparkSession
        whole = spark.createDataFrame([("\n\n".join(r.text for r in rows),)], "text string")
        return whole.select(security.frame(security.sanitize(F.col("text")))).first()[0]
