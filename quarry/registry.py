"""Name -> query and name -> DuckDB SQL, filled by the modules of quarry.plans."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ship

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "m16_hybrid_search"
MODULES = ("scans", "relational", "joins", "aggregates", "evaluation", "documents", "retrieval", "runtime", "writes", "remaining", "layout", "indexes", "surface", "records", "formats")

#: Whole-number sums that DuckDB widens to 128 bits; the oracle returns them in 64, as Spark does.
LONGS = {
    "d04_coalesced_sum": ("total",), "d13_answer_aggregate": ("passed",), "d14_safety_aggregate": ("leaks",), "d15_rank_movement": ("missing", "promoted", "demoted", "unchanged"), "d16_context_aggregate": ("used",),
    "d24_parser_aggregate": ("native", "enhanced"), "d26_budget_capacity": ("model_calls_left",), "d27_page_totals": ("characters",), "j03_search_inventory": ("available",), "l08_heading_groups": ("groups",),
    "n07_rerank_comparison": ("net",), "n11_artifact_recovery": ("recovered",), "n12_filter_audit": ("leaks",), "p12_live_graph": ("bytes",), "p23_run_trace": ("failed",),
}

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the text DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            whole = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in LONGS.get(name, ()))
            _ORACLES[name] = f"SELECT * REPLACE ({whole}) FROM ({sql})" if whole else sql
        return f

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"quarry.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
