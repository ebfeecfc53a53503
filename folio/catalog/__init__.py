"""Named queries over the standard tables, each with an equivalent in plain SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name; ``sql`` gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(text: str) -> str:
    """The SQL of ``folio.functions.text.tokens``."""
    plain = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    apart = rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '([一-鿿]+)', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    paired = f"flatten(list_transform({apart}, lambda t: CASE WHEN regexp_matches(t, '^[一-鿿]{{3,}}$') THEN list_transform(range(1, length(t)), lambda i: t[i:i + 1]) ELSE [t] END))"
    return f"CASE WHEN regexp_matches(lower({text}), '[一-鿿]') THEN {paired} ELSE {plain} END"


def load_all() -> None:
    from folio.catalog import answers, context, graph, guard, metrics, more, pages, relational, retrieval, splitting, state, streams, texts  # noqa: F401
