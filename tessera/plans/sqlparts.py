"""Shared SQL fragments of the DuckDB oracles."""

from __future__ import annotations

from .registry import sql_str


def tokens_cte(name: str, table: str, key: str, text: str, rx: str,
               keep: list[str] | None = None) -> str:
    """``name`` = (key, *keep, i, tok, beg, end); i from 0; byte offsets."""
    keep = keep or []
    kc = ", ".join([key] + keep)
    return f"""
{name}_l AS (SELECT {kc}, regexp_extract_all({text}, {sql_str(rx)}) AS toks FROM {table}),
{name}_u AS (SELECT {kc}, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM {name}_l),
{name} AS MATERIALIZED (
  SELECT {kc}, CAST(i AS BIGINT) AS i, tok,
         CAST(sum(strlen(tok)) OVER (PARTITION BY {key} ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(tok) AS BIGINT) AS beg,
         CAST(sum(strlen(tok)) OVER (PARTITION BY {key} ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end"
  FROM {name}_u)"""


def byte_fold_sql(s: str, modulus: int) -> str:
    return (f"CASE WHEN strlen({s}) = 0 THEN 0 ELSE list_reduce(list_transform("
            f"range(strlen({s})), lambda k: ('0x' || substr(hex(encode({s})), 2*k+1, 2))::BIGINT),"
            f" lambda h, b: (h*2 + b) % {modulus}) END")
