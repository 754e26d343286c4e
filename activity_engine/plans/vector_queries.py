"""Vectors: norms, centroids, nearest references, encoders, projection, density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import vectors as vf
from activity_engine.operators import density, hierarchy, projection, vectors
from activity_engine.plans.registry import Tables, query

_VEC = "list_transform(embedding, lambda x: x::double)"
_MEANS = """m as (select label, list(x order by pos) as centroid from (select label, pos, avg(x::double) as x from (
  select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings) group by label, pos) group by label)"""


@query(f"""select vec_id, round(sqrt(list_sum(list_transform({_VEC}, lambda x: x * x))), 5) as norm,
 round(sqrt(list_sum(list_transform({_VEC}, lambda x: x * x))) / (sqrt(list_sum(list_transform({_VEC}, lambda x: x * x))) + 1e-8), 5) as unit_norm from embeddings""")
def l2_norm(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.round(vf.norm(v), 5).alias("norm"), F.round(vf.norm(vf.normalised(v)), 5).alias("unit_norm")
    )


@query(f"with {_MEANS} select label, pos::int as pos, round(x, 6) as x from (select label, unnest(centroid) as x, unnest(range(len(centroid))) as pos from m)")
def centroids(t: Tables) -> DataFrame:
    means = vectors.centroids(t.embeddings, "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query(f"""with {_MEANS}, d as (select e.label, vec_id, round(sqrt(list_sum(list_transform(list_zip({_VEC}, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as distance
 from embeddings e join m using (label)) select label, vec_id, distance from (select *, row_number() over (partition by label order by distance, vec_id) as rn from d) where rn = 1""")
def representative(t: Tables) -> DataFrame:
    means = vectors.centroids(t.embeddings, "label", "embedding")
    return vectors.representatives(t.embeddings, "label", "vec_id", "embedding", means)


@query(f"""with {_MEANS}, s as (select vec_id, m.label, round(list_cosine_similarity({_VEC}, centroid), 9) as similarity from embeddings, m)
 select vec_id, case when similarity >= 0.6 then label end::varchar as nearest, case when similarity >= 0.6 then similarity end as similarity from (
 select *, row_number() over (partition by vec_id order by similarity desc, label) as rn from s) where rn = 1""")
def nearest_centroid(t: Tables) -> DataFrame:
    means = vectors.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "nearest")
    points = t.embeddings.select("vec_id", "embedding")
    found = vectors.nearest_reference(points, means, "embedding", "nearest", "centroid", 0.6)
    return found.select("vec_id", F.col("nearest").cast("string").alias("nearest"), "similarity")


@query(f"with {_MEANS} select vec_id, label, round(list_cosine_similarity({_VEC}, centroid), 6) as similarity from embeddings join m using (label)")
def cosine_to_centroid(t: Tables) -> DataFrame:
    joined = vectors.with_centroid(t.embeddings, "label", vectors.centroids(t.embeddings, "label", "embedding"))
    return joined.select("vec_id", "label", F.round(vf.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


@query("""select label, count(*) as n, round(count(*)::double / (select count(*) from embeddings), 6) as share,
 case label when 0 then 'noise' else 'group ' || label end as name from embeddings group by label""")
def cluster_sizes(t: Tables) -> DataFrame:
    name = density.cluster_name(F.col("label"), {0: "noise"}, F.concat(F.lit("group "), "label"))
    return density.cluster_sizes(t.embeddings, "label").withColumn("name", name)


_WORDS = r"unnest(list_filter(string_split_regex(lower(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> ''))"
_SLOT = "('0x' || left(md5(word), 4))::int % 256"


def _encoded_sql(table: str, key: str) -> str:
    return f"(select {key}, {_SLOT} as slot, count(*)::double as n from (select {key}, {_WORDS} as word from {table}) group by all)"


@query(f"select doc_id, count(*)::int as used, sum(n) as words, round(sqrt(sum(n * n)), 6) as norm from {_encoded_sql('documents', 'doc_id')} group by doc_id")
def embed_documents(t: Tables) -> DataFrame:
    encoded = vectors.encode(t.texts, "doc_id", "text", vectors.hashed_words())
    v = F.col("embedding")
    return encoded.select(
        "doc_id", F.size(F.filter(v, lambda x: x > 0)).alias("used"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("words"),
        F.round(vf.norm(v), 6).alias("norm"),
    )


@query(f"""with d as {_encoded_sql('documents', 'doc_id')}, i as {_encoded_sql('benchmark', 'item_id')},
 dn as (select doc_id, sqrt(sum(n * n)) as norm from d group by doc_id), "in" as (select item_id, sqrt(sum(n * n)) as norm from i group by item_id),
 s as (select doc_id, item_id, sum(d.n * i.n) as dot from d join i using (slot) group by all),
 c as (select doc_id, item_id, round(dot / ((dn.norm + 1e-8) * ("in".norm + 1e-8)), 9) as similarity from s join dn using (doc_id) join "in" using (item_id))
 select doc_id, item_id, similarity from (select *, row_number() over (partition by doc_id order by similarity desc, item_id) as rn from c) where rn = 1 and similarity >= 0.15""")
def text_match(t: Tables) -> DataFrame:
    """Most similar benchmark text of each document."""
    texts = vectors.encode(t.texts, "doc_id", "text", vectors.hashed_words())
    tags = vectors.encode(t.benchmark, "item_id", "text", vectors.hashed_words(), "item")
    found = vectors.nearest_reference(texts, tags, "embedding", "item_id", "item", 0.15)
    return found.filter("item_id is not null").select("doc_id", "item_id", "similarity")


def _projected(t: Tables, k: int) -> DataFrame:
    axes = projection.principal_axes(t.embeddings, "embedding", k)
    return axes.project(t.embeddings.select("vec_id", "embedding"), "embedding")


@query()
def project_2d(t: Tables) -> DataFrame:
    flat = _projected(t, 2)
    return flat.select("vec_id", F.round(F.col("projected")[0], 6).alias("x"), F.round(F.col("projected")[1], 6).alias("y"))


@query()
def project_50d(t: Tables) -> DataFrame:
    flat = _projected(t, 50)
    return flat.select("vec_id", F.posexplode("projected").alias("axis", "x")).withColumn("x", F.round("x", 6))


@query()
def density_clusters(t: Tables) -> DataFrame:
    """Clusters of at least 60 vectors by a density hierarchy over 50 dimensions; -1 is noise."""
    return hierarchy.density_hierarchy(_projected(t, 50), "vec_id", "projected")


@query()
def density_sizes(t: Tables) -> DataFrame:
    """Size and share of each density cluster and of the noise."""
    return density.cluster_sizes(hierarchy.density_hierarchy(_projected(t, 50), "vec_id", "projected"), "cluster")
