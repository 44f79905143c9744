"""The queries by name, and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.operators.graph import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Folders of stored tables that queries share.
_BUILT: dict[tuple, str] = {}

#: The derived corpus: society, chapter, year, grade, thickness, temperature and ship type of every document. Same SQL for both engines.
CORPUS = """
SELECT concat('c', CAST(doc_id AS STRING)) AS chunk_id, doc_id, society, chapter_section, version_year,
  concat(society, ' ', chapter_section, ' (', CAST(version_year AS STRING), '): ', grade, ' plate thickness not less than ',
         CAST(10 + doc_id % 9 AS STRING), ' mm, preheat ', CAST(100 + 25 * (doc_id % 3) AS STRING), ' C for ', ship,
         CASE WHEN doc_id % 8 = 0 THEN ', except DH32 on ferry. ' ELSE '. ' END, text) AS text
FROM (SELECT doc_id, text,
    CASE doc_id % 10 WHEN 0 THEN 'DNV' WHEN 1 THEN 'ABS' WHEN 2 THEN 'CCS' WHEN 3 THEN 'LR' WHEN 4 THEN 'BV'
                     WHEN 5 THEN 'NK' WHEN 6 THEN 'RINA' WHEN 7 THEN 'KR' WHEN 8 THEN 'IMO' ELSE 'IACS' END AS society,
    concat('Pt.', CAST(doc_id % 5 + 1 AS STRING), ' Ch.', CAST(doc_id % 7 + 1 AS STRING)) AS chapter_section,
    2015 + doc_id % 10 AS version_year,
    CASE doc_id % 4 WHEN 0 THEN 'EH36' WHEN 1 THEN 'AH32' WHEN 2 THEN 'DH36' ELSE 'EH40' END AS grade,
    CASE doc_id % 6 WHEN 0 THEN 'bulk carrier' WHEN 1 THEN 'oil tanker' WHEN 2 THEN 'LNG carrier'
                    WHEN 3 THEN 'container ship' WHEN 4 THEN 'FPSO' ELSE 'drillship' END AS ship
  FROM {documents}) k
"""
#: Queries over the benchmark items, with the words that query rules look for.
QUESTIONS = """
SELECT item_id AS query_id,
  concat(CASE item_id % 4 WHEN 0 THEN 'Compare DNV and ABS' WHEN 1 THEN 'Why does CCS' WHEN 2 THEN 'Summary of all LR' ELSE 'List' END,
    ' Pt.', CAST(item_id % 5 + 1 AS STRING), CASE WHEN item_id % 3 = 0 THEN ' Ch.2' ELSE '' END,
    CASE item_id % 5 WHEN 0 THEN ' EH36 fatigue' WHEN 1 THEN ' welding preheat 125 C' WHEN 2 THEN ' 2019 thickness requirement' ELSE ' rules' END,
    CASE WHEN item_id % 2 = 0 THEN concat(' ', text) ELSE '' END) AS query
FROM {benchmark}
"""
GRAPH_EDGES = """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS src, concat('r', CAST(n_regionkey AS STRING)) AS dst, 'part_of' AS rtype FROM {nation}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), 'located_in' FROM {supplier}
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'located_in' FROM {customer}
UNION ALL SELECT DISTINCT concat('p', CAST(l_partkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)), 'supplied_by' FROM {lineitem}
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('n', CAST((n_nationkey + 1) % 25 AS STRING)), 'similar_to' FROM {nation}
"""
GRAPH_NODES = """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS entity_id, r_name AS name, 'region' AS etype FROM {region}
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), n_name, 'nation' FROM {nation}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), s_name, 'supplier' FROM {supplier}
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), c_name, 'customer' FROM {customer}
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), p_name, 'part' FROM {part}
"""
#: One Markdown table per order; rows in line order.
MARKDOWN_SPARK = """
SELECT l_orderkey AS table_id, concat('| line | part | flag |', chr(10), '|---|---|---|', chr(10),
  array_join(transform(array_sort(collect_list(struct(l_linenumber AS k, concat('| ', CAST(l_linenumber AS STRING), ' | part ', CAST(l_partkey AS STRING), ' | ', l_returnflag, ' |') AS v))), x -> x.v), chr(10))) AS markdown
FROM {lineitem} GROUP BY l_orderkey
"""
MARKDOWN_DUCK = """
SELECT l_orderkey AS table_id, concat('| line | part | flag |', chr(10), '|---|---|---|', chr(10), string_agg(v, chr(10) ORDER BY l_linenumber, v)) AS markdown
FROM (SELECT l_orderkey, l_linenumber, concat('| ', CAST(l_linenumber AS STRING), ' | part ', CAST(l_partkey AS STRING), ' | ', l_returnflag, ' |') AS v FROM lineitem) GROUP BY l_orderkey
"""
_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(text: str) -> str:
    for n in _NAMES:
        text = text.replace("{" + n + "}", n)
    return text


class Tables:
    """The tables of a folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        used = {n: getattr(self, n) for n in _NAMES if "{" + n + "}" in text}
        return self.spark.sql(text, **used, **views)

    @property
    def corpus(self) -> DataFrame:
        return self.sql(CORPUS)

    def once(self, name: str, build) -> str:
        """The folder that build(path) has filled; built once for a session and a folder of tables."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _BUILT:
            path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
            build(path)
            _BUILT[key] = path
        return _BUILT[key]

    @property
    def questions(self) -> DataFrame:
        return self.sql(QUESTIONS)


def query(oracle: str | None = None, **views: str):
    """Register f(tables) under its name; oracle is DuckDB SQL, with views as common table expressions before it."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            known = {"corpus": CORPUS, "questions": QUESTIONS, "edges": GRAPH_EDGES, "nodes": GRAPH_NODES, "tables_md": MARKDOWN_DUCK}
            words = set(re.findall(r"\w+", oracle + " ".join(views.values())))
            needed = {n: duck(s) for n, s in known.items() if n in words} | views
            body = oracle.strip()
            if needed:
                ctes = ", ".join(f"{n} AS ({s})" for n, s in needed.items())
                body = f"WITH RECURSIVE {ctes} {body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return register
