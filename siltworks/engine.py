"""Ingest, list, delete and retrieve over one collection: the operators put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import ids
from siltworks.operators import chunking, conversation, listing, search, store

Embed = Callable[[DataFrame, str, str], DataFrame]
NOTHING_FOUND = "I could not find this in the stored documents."


class Engine:
    """A collection with its registry. ``embed``: (rows, key, text) to (key, dense); offline a hashing stand-in."""

    def __init__(self, spark: SparkSession, path: str | None = None, embed: Embed | None = None, conf: chunking.Settings | None = None):
        self.spark, self.points = spark, store.PointStore(spark, path)
        self.embed, self.conf = embed or (lambda df, k, t: search.hashed_embedding(df, k, t).select(k, "dense")), conf or chunking.Settings()

    def ingest(self, docs: DataFrame, key: str = "file_id", text: str = "text", name: str = "main") -> None:
        """Chunk, embed and store documents; they are stored inactive and made active once all are in. Same text, same keys."""
        ch = chunking.chunk(docs.where(F.col(key).isNotNull()), key, text, self.conf, scope={"file_id": F.col(key)})
        vec = self.embed(ch.dropDuplicates(["chunk_id"]), "chunk_id", "text")
        pts = ch.join(vec, "chunk_id").withColumnRenamed(key, "file_id").withColumn("is_active", F.lit(False))
        pts = store.built(pts).select("point_id", "file_id", "chunk_index", "chunk_type", "text", "dense", "is_active")
        self.points.upsert(name, pts, "chunk_index")
        now = docs.select(F.col(key).alias("file_id")).distinct()
        stored = self.points.read(name)
        mine = stored.join(now, "file_id", "left_semi").withColumn("is_active", F.lit(True))
        self.points.upsert(name, mine, "chunk_index")

    def list_files(self, name: str = "main") -> DataFrame:
        p = self.points.read(name).withColumn("at", F.lit(""))
        return listing.by_file(p, "file_id", "chunk_index", "at", ["chunk_type"], "is_active").drop("completed_at")

    def delete_file(self, file_id: str, name: str = "main") -> dict[str, int]:
        return self.points.delete(name, file_id)

    def retrieve(self, question: str, limit: int = 5, threshold: float = 0.35, filters: dict | None = None, active: bool | None = True, name: str = "main") -> DataFrame:
        """(point_id, file_id, text, score, rank) of the best chunks. Raises on a blank question or a limit out of 1..100."""
        if not question.strip() or not 1 <= limit <= 100 or not 0 <= threshold <= 1:
            raise ValueError("a question, a limit of 1 to 100 and a threshold of 0 to 1 are needed")
        q = self.embed(self.spark.createDataFrame([("q", question)], "id string, text string"), "id", "text").first()["dense"]
        tree = filters if active is None else search.required(filters, {"key": "is_active", "match": {"value": active}})
        hit = search.top_k(self.points.read(name), list(q), limit, threshold, tree, id_col="point_id", vec="dense")
        from pyspark.sql import Window

        return hit.select("point_id", "file_id", "text", "score", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).alias("rank"))  # at most 100 rows


class Conversation:
    """Questions of a session: rewriting, retrieving and answering are functions that are passed in.

    rewrite(question, history) to question; retrieve(question) to a list of dicts with ``text``; answer(question, texts) to
    text. The last ``keep`` messages of a session are kept.
    """

    def __init__(self, rewrite: Callable, retrieve: Callable, answer: Callable, keep: int = 40):
        self.rewrite, self.retrieve, self.answer, self.keep = rewrite, retrieve, answer, keep
        self.sessions: dict[str, list[dict]] = {}

    @staticmethod
    def session_of(user_id: str | None) -> str:
        import uuid

        return f"auto:{uuid.uuid5(uuid.NAMESPACE_DNS, user_id or 'anonymous')}"

    @staticmethod
    def messages(history: list[dict] | None) -> list[dict]:
        out: list[dict] = []
        for m in history or []:
            if m.get("role") in ("user", "assistant") and (m.get("content") or "").strip():
                out.append({"role": m["role"], "content": m["content"].strip()})
            elif (m.get("question") or "").strip():
                out.append({"role": "user", "content": m["question"].strip()})
                if (m.get("answer") or "").strip():
                    out.append({"role": "assistant", "content": m["answer"].strip()})
        return out

    def ask(self, question: str, session_id: str | None = None, user_id: str | None = None, history: list[dict] | None = None) -> dict:
        if not (question or "").strip():
            raise ValueError("a question is needed")
        session = session_id or self.session_of(user_id)
        held = self.messages(history) if history else self.sessions.get(session, [])
        query = self.rewrite(question, held)
        texts = [h["text"].strip() for h in self.retrieve(query)[:3] if h["text"].strip()]
        said = self.answer(query, texts) if texts else NOTHING_FOUND
        self.sessions[session] = [*held, {"role": "user", "content": question.strip()}, {"role": "assistant", "content": said}][-self.keep :]
        return {"session_id": session, "query": query, "answer": said, "retrieved_chunks": texts}


__all__ = ["Conversation", "Engine", "conversation", "ids"]
