"""Registry, table access and the derived texts that queries and checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import scan_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Stop words of the registered term queries and of their checks; the operators take any list
# and use Spark's English one by default.
STOP_WORDS = ("a an and are as at be by for from has he in is it its of on that the to was were "
              "will with").split()


#: A text per order is built and searched from a few bytes, so a split of the table is far too much for one task.
ORDERS_PER_TASK = 100_000


class Tables:
    """Given tables by attribute: t.documents, t.orders, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return scan_table(self.spark, self.folder, name)

    def texts(self) -> DataFrame:
        """documents as (id, text), spread over the cores for the costly pattern work."""
        return spread(self.documents.select(F.col("doc_id").alias("id"), "text"))

    def corpus(self) -> DataFrame:
        """documents, pages and one derived text per order, as (id, text)."""
        parts = [
            spread(self.documents.select("doc_id", "text")).select(F.expr("'d' || CAST(doc_id AS STRING)").alias("id"), "text"),
            spread(self.pages.select("page_id", "html")).select(F.expr("'p' || CAST(page_id AS STRING)").alias("id"), F.col("html").alias("text")),
            self.order_texts().select(F.expr("'o' || CAST(id AS STRING)").alias("id"), "text"),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def order_texts(self) -> DataFrame:
        """One derived text per order; together they hold every kind of finding."""
        keys = spread(self.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ORDERS_PER_TASK)
        return keys.select(F.col("o_orderkey").alias("id"), F.expr(RECIPE).alias("text"))

    def labelled(self) -> DataFrame:
        """documents with a safe / unsafe label from the labels table."""
        labels = self.labels.select("doc_id", F.expr("IF(toxic = 1, 'unsafe', 'safe')").alias("label"))
        return self.documents.select("doc_id", "text", "source", "lang").join(labels, "doc_id")

    def scored(self) -> DataFrame:
        """(doc_id, y, p): true class and a deterministic stand-in for a model's probability."""
        return self.labels.select("doc_id", F.col("toxic").alias("y"), F.expr(SCORE).alias("p"))


def query(key: str, sql: str | None = None):
    """Register a query that takes Tables; `sql` is its check."""
    def wrap(build):
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return wrap


# Reads the same in Spark SQL and DuckDB. A modulo class per kind; the last ones hold
# overlaps, several findings, or none.
_K, _C = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"
_H = f"md5({_K})"
_DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_NL = "chr(10)"
RECIPE = f"""CASE o_orderkey % 26
 WHEN 0 THEN 'ssn ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' on file'
 WHEN 1 THEN 'key AKIA' || upper(substr({_H}, 1, 16)) || ' end'
 WHEN 2 THEN 'use ghp_' || {_H} || '0000 here'
 WHEN 3 THEN 'export aws_secret_access_key=' || {_H} || '01234567'
 WHEN 4 THEN 'bot xoxb-' || lpad({_K}, 10, '0') || '-' || {_H}
 WHEN 5 THEN 'pay sk_live_' || {_H} || ' now'
 WHEN 6 THEN 'map AIza' || substr({_H} || {_H}, 1, 35) || ' on'
 WHEN 7 THEN 'bearer eyJ' || {_H} || '.' || {_H} || '.' || {_H}
 WHEN 8 THEN 'DB: postgres://u:p@db' || {_C} || '.example.com/app ok'
 WHEN 9 THEN 'see -----BEGIN RSA PRIVATE KEY-----' || {_NL} || {_H} || {_NL} || '-----END RSA PRIVATE KEY----- end'
 WHEN 10 THEN 'login with password=' || {_H} || ' and go'
 WHEN 11 THEN 'RSA token: rsa_token=' || {_H} || '== next'
 WHEN 12 THEN 'RSA_KEY: ' || {_H} || ' tail'
 WHEN 13 THEN 'ssh-rsa ' || {_H} || {_H} || ' host'
 WHEN 14 THEN 'ssh-ed25519 ' || {_H} || {_H} || '== host'
 WHEN 15 THEN '-----BEGIN OPENSSH PUBLIC KEY-----' || {_NL} || {_H} || {_NL} || '-----END OPENSSH PUBLIC KEY-----'
 WHEN 16 THEN 'my dob is ' || {_DAY}
 WHEN 17 THEN 'born ' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 1, 4) || ', moved later'
 WHEN 18 THEN 'geboren ' || substr({_DAY}, 9, 2) || '.' || substr({_DAY}, 6, 2) || '.' || substr({_DAY}, 1, 4)
 WHEN 19 THEN 'call x+44 ' || lpad({_K}, 7, '2')
 WHEN 20 THEN 'mail u' || {_K} || '@ex.com or (215) 555-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' ip 10.0.' || CAST(o_orderkey % 300 AS STRING) || '.1'
 WHEN 21 THEN 'card 4242 4242 4242 ' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' exp 12/29'
 WHEN 22 THEN 'password=foo' || {_K} || '@bar.com now and more text'
 WHEN 23 THEN 'token = "' || {_H} || '" is quoted'
 WHEN 24 THEN 'host 10.1.' || CAST(o_orderkey % 256 AS STRING) || '.7 answered'
 ELSE 'plain words, order ' || {_K} || ' of customer ' || {_C} END"""

# A number in [0, 1) from a hash, leaning to the true class.
SCORE = ("ROUND(CAST(conv(substr(md5(CAST(doc_id AS STRING)), 1, 4), 16, 10) AS DOUBLE) / 65536.0 * 0.7"
         " + toxic * 0.25, 3)")
SCORE_SQL = ("ROUND(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::INT AS DOUBLE) / 65536.0 * 0.7"
             " + toxic * 0.25, 3)")

CORPUS_SQL = f"""corpus AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), {RECIPE} FROM orders)"""
ORDER_TEXTS_SQL = f"order_texts AS (SELECT o_orderkey AS id, {RECIPE} AS text FROM orders)"
TEXTS_SQL = "texts AS (SELECT doc_id AS id, text FROM documents)"
LABELLED_SQL = """labelled AS (SELECT d.doc_id, d.text, d.source, d.lang,
  CASE WHEN l.toxic = 1 THEN 'unsafe' ELSE 'safe' END AS label FROM documents d JOIN labels l USING (doc_id))"""
SCORED_SQL = f"scored AS (SELECT doc_id, toxic AS y, {SCORE_SQL} AS p FROM labels)"


def hash_sql(seed: str | int, key: str) -> str:
    """DuckDB form of operators.ranking.hash_order."""
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


def unit_sql(seed: str | int, key: str) -> str:
    """DuckDB form of hash_unit over hash_order."""
    return f"(CAST(('0x' || substr({hash_sql(seed, key)}, 1, 8))::BIGINT AS DOUBLE) / 4294967296.0)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
