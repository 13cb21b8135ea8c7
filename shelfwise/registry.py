"""All queries by name, each a function (spark, sf_dir) -> DataFrame, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import cube
from .operators.dimensions import DIMENSION_SQL
from .operators.forecasting import TEXTS as FORECASTING
from .operators.ingest import TEXTS as INGEST
from .operators.items import ITEM_SQL
from .operators.mining import ITEMSETS
from .operators.mining import TEXTS as MINING
from .operators.quality import CHECKS
from .operators.relational import TEXTS as RELATIONAL
from .operators.reports import REPORTS, run_sql
from .plans import causality, decided, fitted, forecasts, spans
from .plans.ledger import LEDGER_SQL
from .plans.views import VIEW_SQL, Mart
from .sources.roles import ROLE_SQL, roles

TITLES = {
    "S1": "sales_kpis", "S2": "daily_trend", "S3": "weekly_trend", "S4": "monthly_trend", "S5": "quarterly_trend", "S6": "yearly_trend", "S7": "year_over_year", "S8": "top_items_revenue",
    "S9": "top_items_units", "S10": "top_items_frequency", "S11": "categories", "B1": "site_performance", "B2": "site_category_matrix", "B3": "site_category_rollup", "B4": "top3_per_category_site", "B5": "site_scorecard",
    "O1": "time_rollup", "O18": "cube",
}


def mart(spark: SparkSession, sf_dir: str) -> Mart:
    return Mart(roles(spark, sf_dir))


def _prelude() -> str:
    named = ", ".join(f"t_{t} as (select * from {t})" for t in ("sales", "receipts", "batches", "calendar"))
    return f"with {ROLE_SQL}, {named}, {LEDGER_SQL}, {VIEW_SQL}, v_itemsets as {ITEMSETS}"


def with_roles(text: str) -> str:
    """SQL on the source tables alone: the roles and views as common table expressions before the text."""
    return f"{_prelude()}, {text[5:]}" if text.startswith("with ") else f"{_prelude()} {text}"


def _key(name: str) -> str:
    return f"{name}_{TITLES[name]}" if name in TITLES else name


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, mart(spark, sf_dir), text)


#: a text for both engines, or a pair (Spark's, the other's)
TEXTS = REPORTS | CHECKS | RELATIONAL | MINING | FORECASTING | INGEST | {"ST2_run_onset": fitted.ST2}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {_key(name): _run(text if isinstance(text, str) else text[0]) for name, text in TEXTS.items()}
ORACLES: dict[str, str] = {_key(name): with_roles(text if isinstance(text, str) else text[1]) for name, text in TEXTS.items()}

QUERIES |= fitted.QUERIES | decided.QUERIES | forecasts.QUERIES | causality.QUERIES | spans.QUERIES
ORACLES |= fitted.ORACLES | {name: with_roles(text) for name, text in (decided.SQL | causality.SQL | spans.SQL).items()}
QUERIES |= {name: (lambda spark, sf_dir, q=q: cube.answer(mart(spark, sf_dir), q)) for name, q in cube.QUESTIONS.items()}
ORACLES |= {name: with_roles(text) for name, text in cube.SQL.items()}
ORACLES |= {"N6_items": with_roles(ITEM_SQL.strip()), "N6_dropped": with_roles(f"select count(*) as items, count(*) filter (where f.item_key is null) as dropped from (select distinct item_key from t_sales) s left join ({ITEM_SQL}) f on f.item_key = s.item_key")}
ORACLES |= {f"V{k}_{name[2:]}": with_roles(f"select * from {name}") for k, name in fitted.VIEWS.items()}
ORACLES |= {f"E4_{name}": with_roles(text) for name, text in DIMENSION_SQL.items()}
