"""The registered query of every corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.llm import decontamination, exact_dedup, html_extraction, langid, mixing, pii, sharding, simhash, toxicity, url_filters
from sparkscour.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.numbered(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched in minutes that follow from page_id, against entries that follow from the pages' hosts."""
    pages = table(spark, sf_dir, "pages").withColumn("fetched", F.col("page_id") * 7919 % 525600)
    hosts = pages.select(url_filters.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = lambda at, n: F.conv(F.substring(F.md5("host"), at, n), 16, 10).cast("long")
    start, length = digit(1, 5) % 525600, digit(6, 5) % 300000 + 1
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    kind = F.when(digit(11, 1) < 6, "host").when(digit(11, 1) < 8, "domain").when(digit(11, 1) < 11, "prefix")
    value = F.when(kind == "host", F.col("host")).when(kind == "domain", parent).otherwise(F.concat("host", F.lit("/en")))
    entry = lambda at, action: F.struct(kind.alias("kind"), value.alias("value"), at.alias("at"), F.lit(action).alias("action"))
    entries = hosts.select(F.explode(F.array(entry(start, "add"), entry(start + length, "remove"), entry(start + 2 * length, "add"))).alias("e")).select("e.*")
    found = url_filters.evaluated(pages, entries)
    return found.withColumn("rules", F.array_join("rules", ","))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("reps")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), near=None)
    base = pii.base_only(F.col("spans"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(of(k) for k in pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_exact_dedup, op3_html_extraction, op4_toxicity, op5_sharding, op6_language_id, op7_url_filters, op8_mixing, op9_pii, op10_simhash)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, w[s : s + least(10, len(w)) - 1] AS win
            FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT len(win) AS l FROM wins),
        places AS (SELECT doc_id, s, l, w[s : s + l - 1] AS win FROM d, lens, unnest(range(1, len(w) - l + 2)) AS t(s)),
        found AS (SELECT doc_id, s, l, item_id FROM places JOIN wins USING (win)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(s, s + l)) AS t(p) GROUP BY 1),
        named AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found),
        listed AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(listed.n, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d
    """,
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                md5('42:' || coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, '')))) AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
                [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight,
                row_number() OVER (ORDER BY source IS NULL, source) AS place
            FROM d GROUP BY source),
        r AS (SELECT *, cap / weight AS ratio FROM s),
        l AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM r),
        level AS (SELECT arg_min(level, struct_pack(ratio := ratio, place := place)) AS level FROM l WHERE level <= ratio),
        t AS (SELECT source, source_size, least(cap, level.level * weight) AS target FROM l, level),
        w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
        o AS (
            SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
                sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
            FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
        SELECT doc_id, size, source_size, target, size * (whole + (middle <= rest)::BIGINT) AS taken FROM o
    """,
    "op7_url_filters": r"""
        WITH p AS (
            SELECT page_id, url, page_id * 7919 % 525600 AS fetched,
                rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
                regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
            FROM pages),
        h AS (SELECT DISTINCT host, md5(host) AS m FROM p WHERE host <> ''),
        d AS (
            SELECT host, ('0x' || m[1:5])::BIGINT % 525600 AS start, ('0x' || m[6:10])::BIGINT % 300000 + 1 AS length, ('0x' || m[11:11])::BIGINT AS k FROM h),
        k AS (
            SELECT *, CASE WHEN k < 6 THEN 'host' WHEN k < 8 THEN 'domain' WHEN k < 11 THEN 'prefix' END AS kind,
                CASE WHEN k < 6 THEN host WHEN k < 8 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || '/en' END AS value
            FROM d),
        e AS (
            SELECT kind, value, start AS at, 'add' AS action FROM k WHERE kind IS NOT NULL
            UNION ALL SELECT kind, value, start + length, 'remove' FROM k WHERE kind IS NOT NULL
            UNION ALL SELECT kind, value, start + 2 * length, 'add' FROM k WHERE kind IS NOT NULL),
        c AS (
            SELECT page_id, kind, value, (SELECT max(struct_pack(at := e.at, action := e.action)) FROM e
                WHERE e.kind = n.kind AND e.value = n.value AND e.at <= fetched) AS last
            FROM (
                SELECT DISTINCT page_id, fetched, kind, value FROM (
                    SELECT page_id, fetched, 'host' AS kind, host AS value FROM p
                    UNION ALL SELECT page_id, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.') FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i)
                    UNION ALL SELECT page_id, fetched, 'prefix', host || array_to_string(string_split(path, '/')[:i], '/') FROM p, unnest(range(2, len(string_split(path, '/')) + 1)) AS t(i))
                WHERE value <> '') AS n),
        r AS (SELECT page_id, count(*) AS n, string_agg(kind || ':' || value, ',' ORDER BY kind || ':' || value) AS rules FROM c WHERE last.action = 'add' GROUP BY 1)
        SELECT page_id, url, fetched, host, coalesce(n, 0)::BIGINT AS n_rules, coalesce(rules, '') AS rules, n IS NOT NULL AS blocked
        FROM p LEFT JOIN r USING (page_id)
    """,
}
