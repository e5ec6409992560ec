"""The registered query of each operator, and its SQL where SQL can state it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossrank.llm import (
    archives,
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    period_runs,
    quality_classifier,
    quality_rules,
    shingle_join,
    sql,
    url_filter,
    whitening,
)
from crossrank.llm.common import table
from crossrank.staging import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(statement: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if statement:
            SQL[fn.__name__] = statement
        return fn

    return register


@query(sql.MIXING)
def op1_mixing(spark, folder):
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query(sql.LINE_DEDUP)
def op2_line_dedup(spark, folder):
    docs = line_dedup.dedup(table(spark, folder, "documents"))
    return docs.select("doc_id", "text", "n_lines", "n_removed")


@query(sql.DECONTAMINATION)
def op3_decontamination(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(sql.SHINGLE_JOIN)
def op4_shingle_join(spark, folder):
    return shingle_join.near_duplicates(table(spark, folder, "documents"))


@query(sql.QUALITY_RULES)
def op5_quality_rules(spark, folder):
    return quality_rules.judge(table(spark, folder, "documents"))


@query(sql.LICENSE_SCAN)
def op6_license_scan(spark, folder):
    return license_scan.scan(table(spark, folder, "documents"))


@query()
def op7_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality_classifier.train(docs, table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id", F.coalesce(quality_classifier.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        quality_classifier.scorer(model)("text").alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query(sql.URL_FILTER)
def op8_url_filter(spark, folder):
    """Hosts under rules of both kinds are seeds on both sides; scores are iterated to their end."""
    rules = url_filter.rules_table(spark, url_filter.RULES)
    return url_filter.judge(table(spark, folder, "pages"), rules)


@query(sql.ARCHIVES)
def op9_archives(spark, folder):
    """Pages as ARC files, converted to WARC files, read back."""
    base = f"{shared_folder(spark)}/crossrank/archives_{uuid.uuid4().hex[:12]}"
    archives.write_arc(table(spark, folder, "pages"), f"{base}/arc")
    archives.write_warc(archives.convert(spark, f"{base}/arc"), f"{base}/warc")
    digest = F.when(F.col("ok"), F.col("payload_digest")).otherwise(F.raise_error("a payload differs from its digest"))
    return archives.read_warc(spark, f"{base}/warc").select(
        "page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to"
    )


@query()
def op10_html_extraction(spark, folder):
    return html_extract.extract(table(spark, folder, "pages"))


@query()
def op11_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    held_out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op12_period_runs(spark, folder):
    return period_runs.report(table(spark, folder, "documents"), period_runs.planted)


@query()
def op13_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))
