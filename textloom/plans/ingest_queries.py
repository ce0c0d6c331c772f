"""Queries of the dump sources and separators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.views import NL, PAGE
from textloom.session import table
from textloom.sources import files, wiki_dump

_ENVELOPE = f"concat('<siteinfo>', source, '</siteinfo>', {NL}, text)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_idx"), F.expr(PAGE).alias("page"))


def header_body_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", wiki_dump.split_envelope(F.expr(_ENVELOPE)).alias("e"))
    return rows.select("doc_id", "e.header", "e.body", "e.footer")


def xml_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("title", "id", "revision_id", "revision_timestamp", "revision_username", "ip", "revision_contributor_id", "revision_restriction", "comment", "text", "leftovers")
    return wiki_dump.columnize(pages(spark, sf_dir)).select("page_idx", *columns, F.size("separators").alias("n_separators"))


def columns_to_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki_dump.rebuild(wiki_dump.columnize(pages(spark, sf_dir)))


def separator_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.separator_choice(table(spark, sf_dir, "documents"), "text")


def separator_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages have each list of separators, the lists numbered by first appearance."""
    from textloom.operators.encode import dict_encode

    lists = wiki_dump.columnize(pages(spark, sf_dir)).select("page_idx", F.expr("transform(separators, s -> regexp_replace(s, '[0-9]', '#'))").alias("separators"))
    facts, _ = dict_encode(lists, "page_idx", "separators")
    return facts.groupBy("code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (header_body_footer, xml_to_columns, columns_to_xml, separator_choice, separator_codes)}

_text = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLES = {
    "header_body_footer": f"SELECT doc_id, concat('<siteinfo>', source, '</siteinfo>') AS header, concat({NL}, text) AS body, '' AS footer FROM documents",
    "xml_to_columns": f"""
        SELECT doc_id AS page_idx, concat(source, ' ', doc_id) AS title, doc_id::INT AS id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END::INT AS revision_id, '2006-03-04T05:06:07Z' AS revision_timestamp,
               CASE WHEN doc_id % 4 <> 0 THEN source END AS revision_username, CASE WHEN doc_id % 4 = 0 THEN concat('10.0.0.', doc_id % 250) END AS ip,
               CASE WHEN doc_id % 4 <> 0 THEN doc_id + 7 ELSE 0 END::INT AS revision_contributor_id, CASE WHEN doc_id % 5 = 0 THEN concat('move=', lang) END AS revision_restriction,
               CASE WHEN doc_id % 3 = 0 THEN lang END AS comment, {_text} AS text, NULL::VARCHAR AS leftovers,
               (6 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END + (doc_id % 3 = 0)::INT)::INT AS n_separators
        FROM documents""",
    "columns_to_xml": f"SELECT doc_id AS page_idx, {PAGE} AS page FROM documents",
    "separator_choice": "WITH s AS (SELECT unnest([' ', chr(10), concat(chr(10), chr(10)), concat(chr(10), '-', chr(10))]) AS separator, unnest([1, 2, 3, 4]) AS k) SELECT separator FROM s WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, separator)) ORDER BY k LIMIT 1",
}
