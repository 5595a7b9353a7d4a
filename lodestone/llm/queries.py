"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, minhash, mixing, nbsvm, packing, pii, secrets, topk, urlfilter, vectors
from lodestone.llm.common import fold, table


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def of_kinds(spans: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.size(of_kinds("spans", (k,))).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(listed(of_kinds("spans", kinds)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op1_minhash_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"))


def op5_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: Host, path and verdict of each rule.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op3_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string"))


def op4_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_columns(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")), pii.KINDS)


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id") != 0)
    model = nbsvm.train(docs, labels)
    return nbsvm.score(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_BOUND).cast("int").alias("predicted"))


QUALITY_BOUND = 0.3


#: Domains of the labelled table, and the shares of all tokens that they are to have.
MIX_TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op7_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), MIX_TARGETS)


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", topk.sign_code(F.col("embedding")).alias("code"))
    return topk.top_k(codes, codes.where("vec_id % 50 = 0"), 10, id_col="vec_id")


def op9_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id") != 0))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op10_secrets_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_columns(secrets.scan(docs, public_vocabulary("byte_bpe_50k.tiktoken")), secrets.KINDS[:3])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_weighted, op2_best_fit_packing, op3_url_digests, op4_pii_boosted, op5_embedding_graph, op6_quality_nbsvm, op7_soft_membership_mixing, op8_multi_index_hashing, op9_language_hierarchy, op10_secrets_token_efficiency)
}

ORACLE_SQL: dict[str, str] = {
    "op8_multi_index_hashing": """
with bits as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end) as b from embeddings),
codes as (select vec_id, cast(array_to_string(b, '') as bit) as code from bits),
pairs as (select q.vec_id as query_id, r.vec_id as neighbor_id, cast(bit_count(xor(q.code, r.code)) as bigint) as distance from codes q join codes r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id and bit_length(q.code) = bit_length(r.code)),
ranked as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from pairs)
select query_id, rank, neighbor_id, distance from ranked where rank <= 10
""",
    "op3_url_digests": """
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
raw as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
parts as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from raw),
rules(rule_host, rule_path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (select page_id, host, path, (select max_by(rule_host || rule_path || ' ' || verdict, length(rule_host || rule_path)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as found from parts)
select page_id, host, path, split_part(found, ' ', 1) as rule, coalesce(split_part(found, ' ', 2), 'allow') as verdict from best
""",
}
