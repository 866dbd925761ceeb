"""Registry of queries, and the adapters that shape the driver's tables like card data.

An adapter is one SELECT in the dialect that Spark and DuckDB share; `{name}` stands for a table or another adapter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADAPTERS = {
    "catalog": """
        SELECT p_partkey AS ord,
          CASE p_partkey % 12 WHEN 0 THEN 'sv' WHEN 1 THEN 'swsh' WHEN 2 THEN 'sm' WHEN 3 THEN 'xy' WHEN 4 THEN 'bw' WHEN 5 THEN 'hgss' WHEN 6 THEN 'pl'
            WHEN 7 THEN 'dp' WHEN 8 THEN 'ex' WHEN 9 THEN 'neo' WHEN 10 THEN 'gym' ELSE 'base' END || CAST(1 + p_partkey % 9 AS STRING)
            || '-' || CAST(p_partkey AS STRING) AS card_id,
          CASE p_partkey % 12 WHEN 0 THEN 'sv' WHEN 1 THEN 'swsh' WHEN 2 THEN 'sm' WHEN 3 THEN 'xy' WHEN 4 THEN 'bw' WHEN 5 THEN 'hgss' WHEN 6 THEN 'pl'
            WHEN 7 THEN 'dp' WHEN 8 THEN 'ex' WHEN 9 THEN 'neo' WHEN 10 THEN 'gym' ELSE 'base' END || CAST(1 + p_partkey % 9 AS STRING) AS set_id,
          CAST(p_partkey AS STRING) AS local_id, p_name AS name, CAST(10 * p_size AS BIGINT) AS hp, CAST(50 + 10 * (p_partkey % 20) AS BIGINT) AS set_total,
          CASE p_partkey % 6 WHEN 0 THEN 'Common' WHEN 1 THEN 'Rare Holo' WHEN 2 THEN 'Ultra Rare' WHEN 3 THEN 'Uncommon' WHEN 4 THEN 'Illustration rare' END AS rarity,
          CASE WHEN p_partkey % 10 <> 0 THEN 'https://img.example/' || CAST(p_partkey AS STRING) END AS image,
          CASE WHEN p_partkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((p_partkey * 37) % 20000 AS DOUBLE) / 128 END AS trend,
          CASE WHEN p_partkey % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((p_partkey * 41) % 20000 AS DOUBLE) / 128 END AS avg_price,
          CASE WHEN p_partkey % 16 <> 0 THEN CAST((p_partkey * 43) % 20000 AS DOUBLE) / 128 END AS low_price
        FROM {part}""",
    "scans": """
        SELECT o_orderkey AS id, o_custkey AS user_id, c.card_id, c.name AS card_name, c.set_id AS card_set, c.local_id AS card_number,
          c.rarity, c.image AS tcgdex_image, c.trend, c.avg_price, c.low_price,
          CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 < 4 THEN 'user/' || CAST(o_orderkey AS STRING) END AS user_card_image,
          CASE WHEN o_orderkey % 11 < 5 THEN 'enhanced/' || CAST(o_orderkey AS STRING) END AS enhanced_front_path,
          CASE o_orderkey % 5 WHEN 0 THEN 'tag' WHEN 1 THEN 'psa' WHEN 2 THEN 'bgs' WHEN 3 THEN 'cgc' ELSE 'sgc' END AS company,
          CAST(100 + (o_orderkey * 37) % 901 AS BIGINT) AS raw_score,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(300 + (o_orderkey * 53) % 701 AS BIGINT) END AS ai_score,
          CASE WHEN o_orderkey % 3 < 2 THEN CAST(1 + o_orderkey % 10 AS DOUBLE) END AS ai_grade,
          CASE WHEN o_orderkey % 3 < 2 THEN 'AI ' || CAST(1 + o_orderkey % 10 AS STRING) END AS ai_label,
          CAST(1 + o_orderkey % 19 AS DOUBLE) / 2 AS grade_value, 'label ' || CAST(o_orderkey % 19 AS STRING) AS grade_label,
          40 + CAST((o_orderkey * 7) % 210 AS DOUBLE) / 10 AS front_lr, 40 + CAST((o_orderkey * 11) % 210 AS DOUBLE) / 10 AS front_tb,
          CASE WHEN o_orderkey % 9 <> 0 THEN 40 + CAST((o_orderkey * 13) % 400 AS DOUBLE) / 10 END AS back_lr,
          CASE WHEN o_orderkey % 9 <> 0 THEN 40 + CAST((o_orderkey * 17) % 400 AS DOUBLE) / 10 END AS back_tb,
          o_orderpriority = '1-URGENT' AS is_favorite, CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_at
        FROM {orders} o JOIN {catalog} c ON c.ord = o.o_orderkey % (SELECT count(*) FROM {part})""",
    "dings": """
        SELECT l_orderkey AS scan_id, CASE WHEN l_returnflag = 'N' THEN 'FRONT' ELSE 'BACK' END AS side,
          CASE l_suppkey % 5 WHEN 0 THEN 'CENTERING' WHEN 1 THEN 'CORNER WEAR' WHEN 2 THEN 'EDGE WEAR' WHEN 3 THEN 'SURFACE / PLAY WEAR' ELSE 'INK' END AS type,
          'L' || CAST(l_linenumber AS STRING) AS location, CASE WHEN l_linenumber % 7 <> 0 THEN CAST(l_linenumber % 4 AS DOUBLE) END AS severity
        FROM {lineitem}""",
    "defects": """
        SELECT l_orderkey AS scan_id, CASE WHEN l_returnflag = 'N' THEN 'FRONT' ELSE 'back' END AS side,
          CASE l_suppkey % 11 WHEN 0 THEN 'CORNER_WHITENING' WHEN 1 THEN 'CORNER_SOFT' WHEN 2 THEN 'CORNER_FRAYING' WHEN 3 THEN 'EDGE_DAMAGE' WHEN 4 THEN 'EDGE_WHITENING'
            WHEN 5 THEN 'EDGE_CHIPPING' WHEN 6 THEN 'SURFACE_SCRATCH' WHEN 7 THEN 'SURFACE_STAIN' WHEN 8 THEN 'PRINT_LINE' WHEN 9 THEN 'SURFACE_CREASE' ELSE 'ODD' END AS type,
          'L' || CAST(l_linenumber AS STRING) AS location, CAST(1 + l_linenumber % 6 AS INT) AS severity, CAST(50 + l_partkey % 51 AS DOUBLE) / 100 AS confidence
        FROM {lineitem}""",
    "profiles": """
        SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro_monthly' WHEN 2 THEN 'beta_lifetime' END AS tier,
          CASE WHEN c_custkey % 5 = 0 THEN c_name END AS display_name, c_name || '@example.org' AS email, c_acctbal
        FROM {customer}""",
    "reports": """
        SELECT 'card-' || regexp_extract(props, '([0-9]+)', 1) AS tcgdex_id, 'name ' || CAST(event_id AS STRING) AS card_name, event_id,
          CAST(ts AS TIMESTAMP) AS ts, event_id % 3 = 0 AS old
        FROM {events} WHERE event_type = 'error'""",
    "frames": """
        SELECT user_id AS session_id, event_id, ts, CASE WHEN event_id % 13 <> 0 THEN CAST(20 + event_id % 3 AS DOUBLE) END AS "left",
          CAST(15 + event_id % 2 AS DOUBLE) AS top, CAST(40 + event_id % 4 AS DOUBLE) AS width, CAST(10 + (event_id * 7) % 80 AS DOUBLE) AS fill
        FROM {events}""",
    "samples": """
        SELECT user_id % 50 AS device, CASE WHEN event_type = 'click' THEN 'holo' ELSE 'std' END AS kind, event_id,
          CAST((event_id * 7) % 64 AS DOUBLE) / 512 AS o_left, 1 - CAST((event_id * 11) % 64 AS DOUBLE) / 512 AS o_right
        FROM {events}""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
}
# `left` is a keyword in one dialect and quoted differently in the other
ADAPTERS["frames"] = ADAPTERS["frames"].replace('"left"', "x_left")

_HOLE = re.compile(r"\{(\w+)\}")


class Inputs:
    """DataFrames of tables and adapters by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ADAPTERS:
            holes = {h: getattr(self, h) for h in _HOLE.findall(ADAPTERS[name])}
            return self.spark.sql(ADAPTERS[name], **holes)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_adapters(sql: str) -> str:
    """sql for DuckDB: `{name}` holes become names, and the adapters behind them become common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for h in _HOLE.findall(text):
            if h in ADAPTERS and h not in needed:
                need(ADAPTERS[h])
                needed.append(h)

    need(sql)
    plain = lambda text: _HOLE.sub(lambda m: m[1], text)
    parts = [f"{n} AS ({plain(ADAPTERS[n])})" for n in needed]
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:].strip())
        return "WITH " + ",\n".join(parts[:-1] + [parts[-1]]) if parts[:-1] else body
    return f"WITH {',\n'.join(parts)}\n{body}" if parts else body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs as a query; sql: what DuckDB should say."""

    def register(make: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_adapters(sql)
        return make

    return register
