"""The registry of queries, and parts of SQL that several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SQL parts


def q(p: str) -> str:
    return p.replace("'", "''")


def found(col: str, p: str, kind: str) -> str:
    """SQL for the list of matches of p: kind, position, text."""
    m, s = f"regexp_extract_all({col}, '{q(p)}')", f"string_split_regex({col}, '{q(p)}')"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'kind': '{q(kind)}', 'position': CAST({size(f'({s})[1:i]')} + {size(f'({m})[1:i - 1]')} AS INTEGER), 'text': ({m})[i]}})"


def all_found(col: str, patterns: dict[str, str]) -> str:
    return "list_concat(" + ", ".join(found(col, p, k) for k, p in patterns.items()) + ")" if len(patterns) > 1 else found(col, *reversed(next(iter(patterns.items()))))


def n_of(col: str, p: str) -> str:
    return f"CAST(len(regexp_extract_all({col}, '{q(p)}')) AS BIGINT)"


def merged_sql(packs: dict, before: int = 0, after: int = 0) -> str:
    pats = [(k, p) for k, ps in packs.items() for p in ps]
    parts = " UNION ALL ".join(f"SELECT doc_id, greatest(m.position - {before}, 0) AS s, least(m.position + length(m.text) + {after}, length(text)) AS e, {i} AS o, '{k}' AS k FROM (SELECT doc_id, text, unnest({found('text', p, k)}) AS m FROM documents)" for i, (k, p) in enumerate(pats))
    return f"""WITH r AS ({parts}), w AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, o, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r),
      g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, o, e) AS g FROM w)
      SELECT doc_id, CAST(min(s) AS INTEGER) AS region_start, CAST(max(e) AS INTEGER) AS region_end, string_agg(DISTINCT k, ',' ORDER BY k) AS types FROM g GROUP BY doc_id, g"""


ENC = "[ìíîïæ]"
