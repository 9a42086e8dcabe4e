"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import license_scan, mixing, neighbours, packing, pii, resharding, text_dedup, toxicity, vector_dedup, warc
from ._shared import cut, new_folder
from .places import at_rest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Longer documents get up to twice the expected copies of short ones.
    chars = F.coalesce(F.length("text"), F.lit(0))
    return mixing.mix(table(spark, sf_dir, "documents"), doc_weight=1 + chars / (chars + 2000)).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find(table(spark, sf_dir, "documents"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def _is_kind(kind: str):
    return lambda x: x["kind"] == F.lit(kind)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda x: x["rank"] < len(pii.BASE))
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id")) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(True)).alias("held_out"), "score", "predicted")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected shards as they are read back from their files, the others from the plan."""
    docs = at_rest(table(spark, sf_dir, "documents"))
    plan = cut(resharding.planned(docs, resharding.SHARDS, None, None, "doc_id", "text"), "plan")
    path = new_folder(spark, "shards")
    affected = resharding.carried_out(docs, plan, path)
    rows = plan.where(~F.col("shard").isin(affected)).select("doc_id", "size", "text_crc32", "shard", "slot")
    if affected:
        shard, slot = resharding.free_names(docs)
        schema = T.StructType([*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.LongType())])
        data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
        back = spark.read.schema(schema).parquet(path)
        rows = rows.union(back.select("doc_id", (F.length(data) + 8).cast("long"), F.crc32(data), F.col(shard).cast("int"), F.col(slot)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), resharding.old_shard().alias("old_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mixing, op2_warc, op3_license_scan, op4_vector_dedup, op5_minhash_dedup, op6_pii, op7_toxicity, op8_neighbours, op9_packing, op10_resharding, pipeline]
    return {f.__name__: f for f in own}


def _reached(nodes: str, links: str) -> str:
    """Recursive tables: r, who reaches whom over the links (a, b) in both directions; root, the least id that each of nodes (id) reaches, itself included."""
    return f"sides AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}), r(v, u) AS (SELECT a, b FROM sides UNION SELECT r.v, sides.b FROM r JOIN sides ON r.u = sides.a), root AS (SELECT n.id, least(n.id, coalesce(min(r.u), n.id)) AS root FROM {nodes} n LEFT JOIN r ON r.v = n.id GROUP BY n.id)"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHINGLES = f"""w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.c + y.c - i)),
node AS (SELECT doc_id AS id FROM documents)"""

def oracle_sql() -> dict[str, str]:
    """Links in plain SQL, pair by pair. The others rest on seeded hashes, trained weights or a tokenizer; tests/llm holds each
    against a brute-force version."""
    usable = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return {
        "op4_vector_dedup": f"WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {usable}), link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9), node AS (SELECT vec_id AS id FROM embeddings), {_reached('node', 'link')} SELECT id AS vec_id, (SELECT count(*) FROM sides WHERE a = id) AS n_links, root AS component_id, id = root AS kept FROM root",
        "op5_minhash_dedup": f"WITH RECURSIVE {_SHINGLES}, {_reached('node', 'link')} SELECT id AS doc_id, coalesce(c, 0) AS n_shingles, root AS component_id, id = root AS kept FROM root LEFT JOIN n ON n.doc_id = id",
    }
