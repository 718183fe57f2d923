"""Tables that assistants keep: sessions with tags and metadata, versions of documents, cached results of tools, steps and traces.

A session has id, metadata (map), tags (array), archived, expire_at (milliseconds, 0 for never). Writes give the new table, as everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _live(now: int) -> Column:
    return (F.col("expire_at") == 0) | (F.col("expire_at") > now)


def create(sessions: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Sessions with the new ones (id, metadata, expire_at) whose id is not there or has expired; of several with one id the first by metadata's text stays."""
    first = new.groupBy("id").agg(F.min_by(F.struct("metadata", "expire_at"), F.to_json("metadata")).alias("s"))
    fresh = first.select("id", "s.metadata", F.array().cast("array<string>").alias("tags"), F.lit(False).alias("archived"), "s.expire_at")
    held = sessions.where(_live(now))
    return held.unionByName(fresh.join(held.select("id"), "id", "left_anti"))


def active(sessions: DataFrame, now: int) -> DataFrame:
    """Neither archived nor expired."""
    return sessions.where(_live(now) & ~F.col("archived"))


def archived(sessions: DataFrame, now: int) -> DataFrame:
    return sessions.where(_live(now) & F.col("archived"))


def set_archived(sessions: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    return _changed(sessions, ids, archived=F.lit(value))


def update_metadata(sessions: DataFrame, ids: DataFrame, changes: Mapping[str, str]) -> DataFrame:
    """Merges entries into the metadata: keys that are there get the new value."""
    names, values = list(changes), [F.lit(changes[k]) for k in changes]
    new = F.create_map(*[x for k, v in zip(names, values, strict=True) for x in (F.lit(k), v)])
    rest = F.map_filter("metadata", lambda k, _: ~k.isin(names)) if names else F.col("metadata")
    return _changed(sessions, ids, metadata=F.map_concat(rest, new) if names else rest)


def add_tags(sessions: DataFrame, ids: DataFrame, tags: Sequence[str]) -> DataFrame:
    return _changed(sessions, ids, tags=F.array_union("tags", F.array(*map(F.lit, tags))))


def remove_tags(sessions: DataFrame, ids: DataFrame, tags: Sequence[str]) -> DataFrame:
    return _changed(sessions, ids, tags=F.array_except("tags", F.array(*map(F.lit, tags))))


def _changed(sessions: DataFrame, ids: DataFrame, **columns: Column) -> DataFrame:
    marked = sessions.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in columns.items()}).select(*sessions.columns)


def with_tag(sessions: DataFrame, tag: str, now: int) -> DataFrame:
    return active(sessions, now).where(F.array_contains("tags", tag))


def with_metadata(sessions: DataFrame, key: str, value: str, now: int) -> DataFrame:
    return active(sessions, now).where(F.col("metadata")[key] == value)


def delete(sessions: DataFrame, ids: DataFrame, *belonging: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """The sessions without some, and each table that belongs to them, given with its column of session ids, without their rows."""
    gone = ids.select("id").distinct()
    rest = [df.join(gone.withColumnRenamed("id", column), column, "left_anti").select(*df.columns) for df, column in belonging]
    return (sessions.join(gone, "id", "left_anti"), *rest)


def clean_up(sessions: DataFrame, now: int, *belonging: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """delete() of all that have expired."""
    return delete(sessions, sessions.where(~_live(now)), *belonging)


def export(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, document): each session as JSON with its messages in order. A session's messages make one document."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text")))
    per_session = messages.groupBy(F.col("conv_id").alias("id")).agg(listed.alias("messages"))
    both = sessions.join(per_session, "id", "left")
    return both.select("id", F.to_json(F.struct("id", "metadata", "tags", F.coalesce("messages", F.array().cast(per_session.schema["messages"].dataType)).alias("messages"))).alias("document"))


# ---------------------------------------------------------------- documents and their pieces


def store_version(versions: DataFrame, docs: DataFrame) -> DataFrame:
    """Versions (doc_id, version, text) with the texts of ``docs`` as the next version of each document, 1 for a new one."""
    last = versions.groupBy("doc_id").agg(F.max("version").alias("__last"))
    new = docs.join(last, "doc_id", "left").select("doc_id", (F.coalesce("__last", F.lit(0)) + 1).cast("long").alias("version"), "text")
    return versions.unionByName(new)


def at_version(versions: DataFrame, version: int | None = None) -> DataFrame:
    """Each document as it was at a version, the latest up to it; now, if none is given."""
    rows = versions if version is None else versions.where(F.col("version") <= version)
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("version", "text"), "version").alias("v")).select("doc_id", "v.version", "v.text")


def document_statistics(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row: documents, pieces, and bytes of the pieces."""
    of_docs = docs.agg(F.count(F.lit(1)).alias("documents"))
    return of_docs.crossJoin(pieces.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).cast("long").alias("bytes")))


def pieces_with(pieces: DataFrame, keyword: str, limit: int) -> DataFrame:
    """Pieces that contain a word, without regard to case, those with most of it first."""
    low, word = F.lower("piece"), keyword.lower()
    found = (F.char_length(low) - F.char_length(F.replace(low, F.lit(word), F.lit("")))) / len(word)
    return pieces.where(F.contains(low, F.lit(word))).select("doc_id", "chunk", found.cast("long").alias("hits")).orderBy(F.col("hits").desc(), "doc_id", "chunk").limit(limit)


# ---------------------------------------------------------------- tools, steps, traces


def cached(cache: DataFrame, calls: DataFrame, now: int) -> DataFrame:
    """(tool, input, result) for each call; NULL where the cache (tool, input, result, expire_at) has nothing that is still good."""
    return calls.select("tool", "input").join(cache.where(_live(now)).select("tool", "input", "result"), ["tool", "input"], "left")


def remember_results(cache: DataFrame, results: DataFrame, sequence: str = "seq") -> DataFrame:
    """The cache with results put in or replaced; of several for one call the last stays."""
    last = results.groupBy("tool", "input").agg(F.max_by(F.struct("result", "expire_at"), sequence).alias("r")).select("tool", "input", "r.result", "r.expire_at")
    return cache.join(last.select("tool", "input"), ["tool", "input"], "left_anti").select(*last.columns).unionByName(last)


def invalidate(cache: DataFrame, tool: str) -> DataFrame:
    return cache.where(F.col("tool") != tool)


def latest_step(steps: DataFrame) -> DataFrame:
    """The state (agent, step, state, at) that each agent is in; of steps at one time the one with the larger number."""
    order = F.struct("at", "step")
    return steps.groupBy("agent").agg(F.max_by(F.struct("step", "state", "at"), order).alias("s"), F.count(F.lit(1)).alias("steps")).select("agent", "s.step", "s.state", "s.at", "steps")


def rollback(steps: DataFrame, agent: int | str, step: int | str) -> DataFrame:
    """Without the steps of an agent that come after one of its steps; unchanged if there is no such step."""
    limit = steps.where((F.col("agent") == agent) & (F.col("step") == step)).agg(F.max(F.struct("at", "step")).alias("__limit"))
    return steps.crossJoin(F.broadcast(limit)).where((F.col("agent") != agent) | F.col("__limit").isNull() | (F.struct("at", "step") <= F.col("__limit"))).drop("__limit")


def traces(records: DataFrame, run: str = "run") -> DataFrame:
    """Per run of records (run, at, operation, duration, error): how many, how many failed, and the time from the first to the end of the last."""
    return records.groupBy(run).agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("duration").alias("busy"), (F.max(F.col("at") + F.col("duration")) - F.min("at")).alias("elapsed")
    )
