"""Registration of queries: a DataFrame function and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Derived views that the SQL of a query may name; each may name earlier ones.
VIEWS = {
    "monthly": """select n_name as key, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice * (1 - l_discount)) as value
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2""",
    "months": "select cast(unnest(generate_series(min(date), max(date), interval 1 month)) as date) as date from monthly",
    "panel": """select k.key, m.date, v.value from (select distinct key from monthly) k cross join months m
        left join monthly v on v.key = k.key and v.date = m.date and month(m.date) % 5 <> 0""",
    "dense": "select k.key, m.date, v.value from (select distinct key from monthly) k cross join months m left join monthly v on v.key = k.key and v.date = m.date",
    "target_q": """select cast(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as integer) as q_index, cast(date_trunc('quarter', o_orderdate) + interval 2 month as date) as date,
        sum(o_totalprice) as value from orders group by 1, 2""",
    "growth": "select *, 100 * (value / lag(value) over (order by q_index) - 1) as growth from target_q",
    "registry": """select n_name as key, cast(15 + 5 * (n_nationkey % 10) as integer) as lag_days, case n_nationkey % 4 when 0 then 'lin' when 1 then 'chg' when 2 then 'pch' else 'pca' end as tcode,
        r_name as category from nation join region on n_regionkey = r_regionkey""",
    "revisions": """select n_name as key, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice) filter (l_linestatus = 'F') as first, sum(l_extendedprice) as latest
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2""",
    "runs_a": "select user_id, event_id, cast(ts as date) as run_date, ts, value from events where event_type = 'view'",
    "runs_b": "select user_id, event_id, cast(ts as date) as run_date, ts, value from events where event_type = 'click'",
    "misses": """select q_index, date, release_date, model, actual, model - actual as miss from (
        select q_index, date, cast(date + interval 60 day as date) as release_date, lag(growth) over (order by q_index) as model, growth as actual from growth) where model is not null""",
}


def query(sql: str | None = None, levels: tuple[str, ...] = (), ratios: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register under the function's name. levels are rounded to 4 places, ratios to 6, in both engines."""
    places = {c: 4 for c in levels} | {c: 6 for c in ratios}

    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, n) + 0.0 for c, n in places.items()}) if places else f(spark, sf_dir)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = whole(sql, places)
        return run

    return wrap


def whole(sql: str, places: dict[str, int]) -> str:
    """The SQL with the views that it names before it, and its columns rounded."""
    needed: set[str] = set()
    texts = [sql]
    for name in reversed(VIEWS):
        if any(re.search(rf"\b{name}\b", t) for t in texts):
            needed.add(name)
            texts.append(VIEWS[name])
    views = [f"{n} as ({VIEWS[n]})" for n in VIEWS if n in needed]
    body = f"result as ({sql})"
    kept = f" replace ({', '.join(f'round({c}, {n}) + 0.0 as {c}' for c, n in places.items())})" if places else ""
    return f"with {', '.join([*views, body])} select *{kept} from result"


def _loaded() -> None:
    from tidemark.plans import backtest_queries, block_queries, calendar_queries, component_queries, helper_queries, kernel_queries, panel_queries, print_queries, published_queries, recursive_queries, score_queries, source_queries, stream_queries, text_queries, vintage_queries  # noqa: F401


def registered(name: str) -> Query:
    return _QUERIES[name]


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
