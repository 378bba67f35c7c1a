"""The memory store as append-and-supersede tables: listing, ranking, duplicates, claims and mutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.constants import CONTEXT_KINDS, DUPLICATE_FLOOR, MEMORY_KINDS, PRIOR_WEIGHT, RECALL_FLOOR, RRF_K
from heddle.operators.aggregates import feedback_weight
from heddle.operators.ordered import keep_best
from heddle.operators.search import Query, parse
from heddle.operators.similarity import similar_between
from heddle.operators.vectors import fuse, most_similar
from heddle.operators.visibility import path_tier, retired


def active(memory: DataFrame, kind: str | None = None, project: str | None = None, status: str = "confirmed") -> DataFrame:
    """Entries of a status that nothing supersedes, of a kind and exactly of a scope where given."""
    out = memory.filter(F.col("superseded_by").isNull() & (F.col("status") == status))
    if kind:
        out = out.filter(F.col("kind") == kind)
    return out if project is None else out.filter(F.col("scope_project").eqNullSafe(F.lit(project)))


def listing(memory: DataFrame, limit: int) -> DataFrame:
    return memory.orderBy(F.desc("updated"), F.desc("id")).limit(limit)


def weighted(memory: DataFrame, feedback: DataFrame) -> DataFrame:
    w = feedback_weight(feedback).select(F.col("memory_id").alias("id"), "weight")
    return memory.join(w, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(PRIOR_WEIGHT)))


def rescored(ranked: DataFrame, feedback: DataFrame, influence: float = 1.0) -> DataFrame:
    """Ranked entries (id, place from 0) by factor / (k + place); the factor grows with the feedback weight."""
    factor = 1 + influence * ((0.75 + 0.5 * F.col("weight")) - 1)
    return weighted(ranked, feedback).withColumn("score", factor / (RRF_K + F.col("place"))).orderBy(F.desc("score"), "id")


def context(memory: DataFrame, feedback: DataFrame, project: str, limit: int) -> DataFrame:
    """Entries for a project's context: related scopes first, then by weight, update, kind and id; retired ones are out."""
    rank = F.coalesce(F.array_position(F.lit(list(CONTEXT_KINDS)), F.col("kind")).cast("int"), F.lit(0))
    rank = F.when(rank == 0, len(CONTEXT_KINDS) + 1).otherwise(rank)
    own = active(memory).filter(~retired(F.col("title"))).withColumns({"tier": path_tier(F.col("scope_project"), project), "kind_rank": rank})
    return weighted(own.filter(F.col("tier").isNotNull()), feedback).orderBy("tier", F.desc("weight"), F.desc("updated"), "kind_rank", "id").limit(limit)


def normal_text(col: Column) -> Column:
    """Lower case, white space as single spaces, no punctuation at the edges."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(col), r"\s+", " ")), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def duplicate_key() -> list[Column]:
    return [F.lower("title").alias("k_title"), F.sha2("body", 256).alias("k_body"), F.col("kind").alias("k_kind"), F.col("scope_project").alias("k_project"), F.col("scope_tool").alias("k_tool")]


def duplicates(memory: DataFrame, feedback: DataFrame) -> DataFrame:
    """(id, survivor) of entries that equal another of the same kind and scope; the best weight, then the latest, then the largest id survives."""
    own = weighted(active(memory), feedback).select("*", *duplicate_key())
    key = ["k_title", "k_body", "k_kind", "k_project", "k_tool"]
    best = own.groupBy(*key).agg(F.max(F.struct("weight", "updated", "id")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    same = [own[k].eqNullSafe(best[k]) for k in key]
    joined = own.join(best, same[0] & same[1] & same[2] & same[3] & same[4])
    return joined.filter(F.col("best.id") != F.col("id")).select("id", F.col("best.id").alias("survivor"))


def superseded(memory: DataFrame, by: DataFrame) -> DataFrame:
    """memory with superseded_by set from pairs (id, survivor); other rows stay as they are."""
    return memory.join(by.select("id", "survivor"), "id", "left").withColumn("superseded_by", F.coalesce("survivor", "superseded_by")).drop("survivor")


def with_status(memory: DataFrame, ids: DataFrame, status: str, only_from: tuple[str, ...] = ()) -> DataFrame:
    hit = F.col("_hit").isNotNull() & (F.col("status").isin(*only_from) if only_from else F.lit(True))
    return memory.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left").withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def rated(log: DataFrame) -> DataFrame:
    """The latest rating of each rater of each entry, from an append-only log (memory_id, rater, score, created)."""
    return keep_best(log, ["memory_id", "rater"], [F.desc("created"), F.desc("score")])


def claim_state() -> Column:
    """superseded before rejected before confirmed before the claim's own type."""
    return F.when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("status") == "rejected", "rejected").when(F.col("status") == "confirmed", "confirmed").otherwise(F.coalesce(F.get_json_object("metadata", "$.claim_type"), F.lit("observation")))


def invalid_reason() -> Column:
    """Why an entry can't be stored, or null."""
    return (
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is empty")
        .when(F.length("title") > 512, "title is too long")
        .when(F.length("body") > 64_000, "body is too long")
        .when(~F.coalesce(F.col("kind").isin(*MEMORY_KINDS), F.lit(False)), "kind is unknown")
    )


def promoted(candidates: DataFrame, known: DataFrame, per_session: int, overall: int, similar: DataFrame | None = None) -> DataFrame:
    """Candidates (id, session_id, title, body) with outcome: invalid, duplicate, already_known, capped or added.

    similar: the ids of candidates that mean what a known entry says (see similar_known); they are already known too.
    """
    own = candidates.withColumns({"text": normal_text(F.concat_ws(" ", "title", "body")), "bad": F.coalesce(F.trim("title"), F.lit("")) == ""})
    seen = known.select(normal_text(F.concat_ws(" ", "title", "body")).alias("text")).distinct().withColumn("_known", F.lit(1))
    own = own.join(seen, "text", "left")
    if similar is not None:
        own = own.join(similar.select("id").distinct().withColumn("_near", F.lit(1)), "id", "left").withColumn("_known", F.coalesce("_known", "_near")).drop("_near")
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("text").orderBy("id")))
    ok = ~F.col("bad") & F.col("_known").isNull() & (F.col("copy") == 1)
    good = own.filter(ok).withColumn("in_session", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).filter(F.col("in_session") <= per_session)
    added = good.orderBy("id").limit(overall).select("id").withColumn("_added", F.lit(1))
    out = own.join(added, "id", "left")
    return out.select("id", F.when(F.col("bad"), "invalid").when(F.col("_known").isNotNull(), "already_known").when(F.col("copy") > 1, "duplicate").when(F.col("_added").isNull(), "capped").otherwise("added").alias("outcome"))


def similar_known(candidates: DataFrame, known: DataFrame, floor: float = DUPLICATE_FLOOR) -> DataFrame:
    """(id, known_id, similarity) of candidates and known entries (id, scope_project, scope_tool, embedding) of the same scope whose vectors are at the floor or above."""
    scope = lambda df, to: df.select(F.col("id").alias(to), F.col("scope_project").alias(f"{to}_p"), F.col("scope_tool").alias(f"{to}_t"))
    pairs = similar_between(candidates.withColumnRenamed("id", "key"), known.withColumnRenamed("id", "key"), floor)
    out = pairs.join(scope(candidates, "a"), "a").join(scope(known, "b"), "b")
    same = F.col("a_p").eqNullSafe(F.col("b_p")) & F.col("a_t").eqNullSafe(F.col("b_t"))
    return out.filter(same).select(F.col("a").alias("id"), F.col("b").alias("known_id"), "similarity")


def searched(memory: DataFrame, hits: DataFrame, limit: int, kind: str | None = None, project: str | None = None, status: str | None = "confirmed", include_superseded: bool = False) -> DataFrame:
    """Entries among hits (doc, score), best first: the filters run before the limit. Documents of entries are named memory:id, others may be among them."""
    found = hits.filter(F.col("doc").startswith("memory:")).select(F.substring_index("doc", ":", -1).cast("bigint").alias("id"), "score")
    own = memory if status is None else memory.filter(F.col("status") == status)
    own = own if include_superseded else own.filter(F.col("superseded_by").isNull())
    own = own if kind is None else own.filter(F.col("kind") == kind)
    own = own if project is None else own.filter(F.col("scope_project") == project)
    return own.join(found, "id").orderBy("score", "id").limit(limit)


def recalled(memory: DataFrame, find: Callable[[Query], DataFrame], text: str, limit: int = 10, vectors: DataFrame | None = None, vector: list[float] | None = None, semantic: bool | None = None, stemmed: bool = True, floor: float = RECALL_FLOOR, **filters) -> DataFrame:
    """(id, score) of entries for a query, best first. find: gives the hits (doc, score) of a query.

    A blank query lists the newest. semantic False: keywords only. True: similarity only, without a floor, and keywords where
    there is no vector. None: keywords fused with what is similar from the floor on, but keywords only for a phrase.
    vectors: (id, embedding) of entries; vector: the query's.
    """
    query = parse(text, stemmed)
    own = memory if filters.get("status", "confirmed") is None else memory.filter(F.col("status") == filters.get("status", "confirmed"))
    own = own if filters.get("include_superseded") else own.filter(F.col("superseded_by").isNull())
    own = own if not filters.get("kind") else own.filter(F.col("kind") == filters["kind"])
    own = own if not filters.get("project") else own.filter(F.col("scope_project") == filters["project"])
    if query is None:
        return listing(own, limit).select("id", F.lit(0.0).alias("score"))
    near = None if vectors is None or vector is None else own.select("id").join(vectors, "id")
    if semantic and near is not None:
        return most_similar(near, vector, limit, -1.0, key="id").select("id", F.col("similarity").alias("score"))
    words = searched(memory, find(query), limit, **filters).select("id", "score")
    if semantic is not None or query.kind == "phrase" or near is None:
        return words
    near = most_similar(near, vector, limit, floor, key="id").select("id", "similarity")
    return fuse([words, near], "id", [[F.asc("score"), F.asc("id")], [F.desc("similarity"), F.asc("id")]], limit)


def enriched(memory: DataFrame, tags: DataFrame, feedback: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries with their tags, the scores of their raters and the places that they come from, each as an ordered list."""
    listed = lambda df, name, *cols: df.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = memory
    for df, name, cols in ((tags, "tags", ("tag",)), (feedback, "votes", ("rater", "score")), (sources, "sources", ("session_id", "message_seq"))):
        own = listed(df, name, *cols)
        out = out.join(own.withColumnRenamed("memory_id", "id"), "id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def with_vectors(memory: DataFrame, vectors: DataFrame, missing: bool = False) -> DataFrame:
    """Entries with their vectors (id, embedding), or those that have none."""
    return memory.join(vectors.select("id"), "id", "left_anti") if missing else memory.join(vectors, "id")


def tag_changes(tags: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(session_id, tag) after additions and removals; tags are trimmed, lower-cased and never blank, and each counts once."""
    own = lambda df: df.select("session_id", F.lower(F.trim("tag")).alias("tag")).filter(F.col("tag") != "")
    return own(tags).unionByName(own(added)).distinct().join(own(removed), ["session_id", "tag"], "left_anti")


def tombstones(store: DataFrame, new: DataFrame) -> DataFrame:
    """(id, at): each id with the first time that it was put away."""
    return store.unionByName(new).groupBy("id").agg(F.min("at").alias("at"))


def hidden_ids(deleted: DataFrame, ignored: DataFrame) -> DataFrame:
    """The ids that either store hides, each once."""
    return deleted.select("id").union(ignored.select("id")).distinct()


def saved(rows: DataFrame, new: DataFrame, key: str, at: str = "created") -> DataFrame:
    """Rows with new ones in place of those with the same key; of several the latest."""
    return keep_best(rows.unionByName(new, allowMissingColumns=True), [key], [F.desc(at)])


def without_session(summaries: DataFrame, session_id: str) -> DataFrame:
    """Summaries without a session's own, and without aggregates that list it among their children."""
    of_it = F.coalesce(F.array_contains("children", session_id), F.lit(False))
    return summaries.filter(~(F.col("session_id").eqNullSafe(F.lit(session_id)) | of_it))


def source_states(log: DataFrame) -> DataFrame:
    """(source, state, n, first, last) of an append-only log (source, state, at)."""
    return log.groupBy("source", "state").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def undecoded(revisions: DataFrame) -> DataFrame:
    """Captured revisions that no parser has read."""
    return revisions.filter(F.col("decoded_at").isNull()).orderBy("captured_at", "id")


def merged_recommendations(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Recommendations (id, text, state, created_at, evidence of permalink and note): fresh texts, with the stored state and time and all evidence, by permalink, stored notes first; stored ones that are no longer found stay."""
    links = existing.select("id", F.explode("evidence").alias("e"), F.lit(0).alias("k")).unionAll(fresh.select("id", F.explode("evidence"), F.lit(1)))
    links = links.groupBy("id", F.col("e.permalink").alias("permalink")).agg(F.min_by(F.col("e.note"), F.col("k")).alias("note"))
    links = links.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("permalink", "note"))).alias("evidence"))
    a = existing.select("id", *(F.col(c).alias(f"a_{c}") for c in ("text", "state", "created_at")))
    b = fresh.select("id", *(F.col(c).alias(f"b_{c}") for c in ("text", "state", "created_at")))
    out = a.join(b, "id", "full_outer").select("id", F.coalesce("b_text", "a_text").alias("text"), F.coalesce("a_state", "b_state").alias("state"), F.coalesce("a_created_at", "b_created_at").alias("created_at"))
    return out.join(links, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<permalink:string,note:string>>")))


def reviewed(recommendations: DataFrame, log: DataFrame) -> DataFrame:
    """Recommendations with what an append-only review log (id, event, by, at) says: state active from the latest activation on, who and when, and how many evaluations there are."""
    own = log.groupBy("id").agg(F.max_by("by", F.when(F.col("event") == "activated", F.col("at"))).alias("activated_by"), F.max(F.when(F.col("event") == "activated", F.col("at"))).alias("activated_at"), F.count_if(F.col("event") != "activated").alias("evaluations"))
    out = recommendations.join(own, "id", "left")
    return out.withColumns({"state": F.when(F.col("activated_at").isNotNull(), "active").otherwise(F.col("state")), "evaluations": F.coalesce("evaluations", F.lit(0))})
