"""Vector store operations over DataFrames: exact cosine search, upserts, an offline embedder."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import let
from ..functions.tables import written

STORE = "point_id string, template string, embedding array<float>, payload map<string,string>"


def point_id(template: Column) -> Column:
    """A stable id of a template's text."""
    return F.md5(F.encode(template, "utf-8"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null for a zero vector or different sizes."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(x, y) / norm)


def search_similar(store: DataFrame, vector: list[float], limit: int = 5, id_column: str = "point_id") -> DataFrame:
    """The most similar rows, ties by id: a scan with a bounded top-k a task."""
    query = F.array(*[F.lit(float(v)) for v in vector])
    return store.withColumn("score", cosine(F.col("embedding"), query)).where("score is not null").orderBy(F.desc("score"), id_column).limit(limit)


def search_many(queries: DataFrame, store: DataFrame, limit: int = 5, query_block: int = 8192, store_block: int = 65536) -> DataFrame:
    """(query_id, id, score, rank): top matches of many queries in one job, ties by id.

    queries and store have id and embedding.  Both are dealt out in blocks of bounded size; each pair of
    blocks is a group, which multiplies slices of the two and keeps limit candidates a query.  Queries are
    copied to the store's blocks and the store to the (usually one) query blocks; nothing reaches the driver.
    """
    n, m = max(1, -(-queries.count() // query_block)), max(1, -(-store.count() // store_block))
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = queries.select("id", "embedding", block(n).alias("a"), every(m).alias("b"))
    x = store.select("id", "embedding", block(m).alias("b"), every(n).alias("a"))

    def unit(vectors) -> tuple[np.ndarray, np.ndarray]:
        v = np.stack(vectors.to_list()).astype(np.float64)
        norms = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norms == 0, 1, norms), norms[:, 0] > 0

    def top(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for lo in range(0, len(left) if len(right) else 0, 1024):
            ids, (v, real) = left["id"].to_numpy()[lo : lo + 1024], unit(left["embedding"][lo : lo + 1024])
            for at in range(0, len(right), 4096):
                part, (y, there) = right["id"].to_numpy()[at : at + 4096], unit(right["embedding"][at : at + 4096])
                s = np.where(real[:, None] & there, v @ y.T, -np.inf)
                # all that tie with the last of the best stay, so that ids decide
                cut = np.partition(s, -min(limit, len(part)), axis=1)[:, -min(limit, len(part))]
                row, col = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
                found.append(pd.DataFrame({"query_id": ids[row], "id": part[col], "score": s[row, col]}))
        out = pd.concat(found)
        return out.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(limit)

    found = q.groupBy("a", "b").cogroup(x.groupBy("a", "b")).applyInPandas(top, "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with new's points in place of those with equal ids."""
    both = store.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    w = Window.partitionBy("point_id").orderBy("__age")
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__age")


def delete(store: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """store without the points of ids: a list, or a table with point_id."""
    if isinstance(ids, DataFrame):
        return store.join(ids.select("point_id"), "point_id", "left_anti").select(store.columns)
    return store.where(~F.col("point_id").isin(ids))


def get_all(store: DataFrame, limit: int = 100) -> DataFrame:
    return store.orderBy("point_id").limit(limit)


def update_metadata(store: DataFrame, id: str, metadata: dict[str, str]) -> DataFrame:
    more = F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv])
    kept = F.map_filter(F.coalesce("payload", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(metadata)))
    return store.withColumn("payload", F.when(F.col("point_id") == id, F.map_concat(kept, more)).otherwise(F.col("payload")))


class Embedder(Protocol):
    """What a client of an embedding service offers; an empty vector stands for a failure."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_hash(text: Column, dim: int = 64) -> Column:
    """An offline embedding: counts of a text's tokens in places by the first 32 bits of their md5."""
    tokens = F.filter(F.split(F.lower(text), r"[^a-z0-9<*>]+"), lambda t: t != "")
    places = F.transform(tokens, lambda t: F.pmod(F.conv(F.substr(F.md5(t.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))
    # a token a place at most once: the counts of the places that occur, then all places
    counts = let(places, lambda at: F.map_from_entries(F.transform(F.array_distinct(at), lambda p: F.struct(p, F.size(F.filter(at, lambda q: q == p)).cast("float")))))
    return let(counts, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0).cast("float"))))


def embed_with(df: DataFrame, embedder: Embedder, column: str = "template") -> DataFrame:
    """df with embedding by a service's client, a batch a call; distinct texts only should be passed."""

    def run(it):
        for pdf in it:
            yield pdf.assign(embedding=embedder.embed(pdf[column].tolist()))

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<float>")


def embed_cached(templates: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(templates with embedding, the cache for the next call): a service is asked once for each distinct template.

    cache has point_id and embedding.  Templates that it knows are not sent; failures (empty vectors) are not kept, so
    they are asked for again.  Null templates have no embedding.
    """
    wanted = templates.where("template is not null").select(point_id(F.col("template")).alias("point_id"), "template").distinct()
    new = wanted if cache is None else wanted.join(cache.select("point_id"), "point_id", "left_anti")
    fresh = written(embed_with(new, embedder).select("point_id", "embedding"), "embedded")
    kept = fresh.where(F.size("embedding") > 0)
    kept = kept if cache is None else cache.select("point_id", "embedding").unionByName(kept)
    known = kept.unionByName(fresh.where(F.size("embedding") <= 0)).withColumnRenamed("point_id", "__id")
    found = templates.join(known, point_id(F.col("template")) == F.col("__id"), "left").drop("__id")
    return found, written(kept, "embeddings")


def load_counts(templates: DataFrame, embedder: Embedder) -> DataFrame:
    """How many templates a load stores, and for how many the embedding fails (is empty)."""
    e = embed_with(templates.select("template"), embedder).select(F.size("embedding").alias("n"))
    return e.agg(F.count_if(F.col("n") > 0).alias("stored"), F.count_if(F.col("n") <= 0).alias("failed"))


def store_templates(templates: DataFrame, embedder: Embedder | None = None, dim: int = 64) -> DataFrame:
    """Points of a template table; templates whose embedding failed (an empty vector) are left out."""
    t = templates.select("template", "template_id", "count")
    # only a service's vectors can be empty; a filter on the hashed ones would be pushed below the counting
    e = embed_with(t, embedder).where(F.size("embedding") > 0) if embedder is not None else t.withColumn("embedding", embed_hash(F.col("template"), dim))
    payload = F.create_map(F.lit("template"), F.col("template"), F.lit("template_id"), F.col("template_id"), F.lit("count"), F.col("count").cast("string"))
    return e.select(point_id(F.col("template")).alias("point_id"), "template", "embedding", payload.alias("payload"))
