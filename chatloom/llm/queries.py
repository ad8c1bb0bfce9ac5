"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatloom.llm import conversations, embeddings, fingerprints, forest, language, mixing, packing, pii, revisits, spelling, templates, tokens, toxicity
from chatloom.session import fresh_folder, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tune(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[build.__name__] = run
    return run


@register
def op1_best_fit_packing(spark, table):
    return packing.pack_documents(table("documents"), with_ids=False)


@register
def op2_personal_data(spark, table):
    return pii.find(table("documents"))


@register
def op3_toxicity(spark, table):
    docs = table("documents")
    model = toxicity.learn(docs, table("labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@register
def op4_language_id(spark, table):
    docs = table("documents")
    return language.classify(docs, language.learn(docs)).select(
        "doc_id", F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("best").alias("lang_pred"), "score",
    )


@register
def op5_embedding_near_dedup(spark, table):
    return embeddings.near_duplicates(table("embeddings"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page as a full response of one of three addresses of its host, and as a
    revisit of that address some time later, now and then earlier.

    So an address has many responses over time, and the address of a common host
    very many. Validators change every hundred pages; part of the responses tell when
    they were modified. The revisit writes the address in another way; of five, one
    contradicts the validator and one has none or only a time.
    """
    id = F.col("page_id")
    of = lambda **h: F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(k.replace("_", "-")) for k in h]), F.array(*h.values())
    ), lambda _, v: v.isNotNull())
    version = lambda at: F.floor(at / 6000).cast("bigint")
    tag = lambda at: F.concat(F.lit('"'), version(at).cast("string"), F.lit('"'))
    changed = lambda at: (version(at) * 6000).cast("string")
    site = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.lit("/page"), (id % 3).cast("string"))
    sent = id * 60
    response = pages.select(
        (id * 2).alias("record_id"), site.alias("url"), sent.alias("fetched_at"), F.lit("response").alias("kind"),
        of(ETag=tag(sent), Content_Type=F.lit("text/html"), Date=sent.cast("string"), Expires=F.lit("0"),
           Last_Modified=F.when(id % 4 < 2, changed(sent))).alias("headers"),
        F.col("html").alias("page"),
    )
    seen = sent + F.when(id % 7 == 0, -30).otherwise(90) + id % 11 * 300
    other = F.when(id % 3 == 0, F.concat(site, F.lit("/#again"))).when(
        id % 3 == 1, F.regexp_replace(site, "^http:", "https:")
    ).otherwise(F.concat(site, F.lit("?utm_source=x")))
    revisit = pages.select(
        (id * 2 + 1).alias("record_id"), other.alias("url"), seen.alias("fetched_at"), F.lit("revisit").alias("kind"),
        of(etag=F.when(id % 5 == 0, F.lit('"other"')).when(id % 5 != 1, tag(seen)), DATE=seen.cast("string"),
           Server=F.lit("cache"), last_modified=F.when(id % 2 == 0, changed(seen))).alias("headers"),
        F.lit(None).cast("string").alias("page"),
    )
    return response.unionByName(revisit)


@register
def op6_revisit_resolution(spark, table):
    found = revisits.resolve_revisits(captures(table("pages")))
    shown = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return found.select("record_id", "address", "source_id", "outcome", F.array_join(F.array_sort(shown), ";").alias("headers"), "page")


@register
def op7_weighted_fingerprints(spark, table):
    return fingerprints.neighbour_fingerprints(table("documents"))


@register
def op8_ngram_jaccard_join(spark, table):
    return forest.near_duplicate_join(table("documents"))


@register
def op9_line_templates(spark, table):
    docs = table("documents").select("doc_id", "text")
    return templates.drop_recurring_lines(docs, report=True)


@register
def op10_source_mixing(spark, table):
    return mixing.mix(table("documents")).select("doc_id", "size", "source_size", "target", "taken")


@register
def op11_token_files(spark, table):
    path = fresh_folder(spark, "token-files")
    tokens.write_tokens(table("documents"), path)
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op12_spelling_variants(spark, table):
    return spelling.spelling_variants(table("documents"), slip_every=199)


@register
def op13_conversation_repair(spark, table):
    rows = table("conversations")
    return conversations.audit_conversations(conversations.damage(rows), known=rows)
