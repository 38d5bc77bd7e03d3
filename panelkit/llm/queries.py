"""One query per operator over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, chat, conversations, decontaminate, html_text, language, licences, lm, near_dedup, periodic, quality, secrets, tokens
from panelkit.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_quality_rules")
def op7_quality_rules(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    weights = quality.fit_ratio(docs, quality.trusted_ids(load(spark, folder, "labels")))
    return quality.annotate(docs, weights, "quality").select("doc_id", "quality.*")


def _licence_sql() -> str:
    rows = ", ".join(
        "(" + str(i) + ", '" + name + "', [" + ", ".join("'" + g.replace("'", "''") + "'" for g in grams) + "])"
        for i, (name, grams) in enumerate(licences.template_bigrams()))
    return f"""WITH t(tid, name, b) AS (VALUES {rows}),
 l AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)),
  lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS lines FROM documents),
 u AS (SELECT doc_id, CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END AS units FROM l),
 e AS (SELECT doc_id, unnest(units) AS u FROM u),
 w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM e),
 g AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
 p AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS d FROM g, t
  WHERE 2 * least(len(g), len(b)) >= {licences.DICE} * (len(g) + len(b))),
 c AS (SELECT doc_id, count(*) AS n_compared FROM p GROUP BY 1),
 m AS (SELECT doc_id, count(*) AS n_matches, first(name ORDER BY d DESC, name) AS licence, max(d) AS dice,
  string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM p WHERE d >= {licences.DICE} GROUP BY 1)
 SELECT u.doc_id, CAST(len(units) AS BIGINT) AS n_units, coalesce(n_compared, 0) AS n_compared,
 coalesce(n_matches, 0) AS n_matches, licence, dice, coalesce(licences, '') AS licences
 FROM u LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op8_licence_scans", _licence_sql())
def op8_licence_scans(spark, folder):
    return licences.scan(load(spark, folder, "documents"))


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, folder):
    return decontaminate.find(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


@query("op10_chat_formatting")
def op10_chat_formatting(spark, folder):
    return chat.repair(load(spark, folder, "conversations"))


@query("op2_token_output")
def op2_token_output(spark, folder):
    return tokens.round_trip(load(spark, folder, "documents"))


@query("op9_bpe")
def op9_bpe(spark, folder):
    return bpe.digests(load(spark, folder, "documents"))


@query("op4_language_id")
def op4_language_id(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark, folder):
    return near_dedup.classify(load(spark, folder, "documents"), words=2).drop("th")


@query("op1_lm_scoring")
def op1_lm_scoring(spark, folder):
    return lm.score(load(spark, folder, "documents"))


@query("op3_html_extraction")
def op3_html_extraction(spark, folder):
    return html_text.extract(load(spark, folder, "pages"))


@query("op13_secret_scans", secrets.oracle_sql())
def op13_secret_scans(spark, folder):
    return secrets.digests(load(spark, folder, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, folder):
    return periodic.find(load(spark, folder, "documents"), plant=True)


@query("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    return conversations.digests(conversations.damage(load(spark, folder, "conversations")), "gone")
