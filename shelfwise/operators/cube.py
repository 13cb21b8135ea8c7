"""An interactive cube over sales lines: any row and column dimension, measure, slices and dices, drill along hierarchies.

Dimensions, measures and hierarchies are data; a question becomes one aggregation over grouping sets (cells, row totals, column totals,
grand total), so that totals of distinct counts are exact. Labels are ordered by time or by value and cut to the largest ones by a
top-k, never by a sort of all labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.views import Mart

DIMENSIONS: dict[str, Column | str] = {
    "year": "cast(year as string)", "quarter": "concat(year, '-Q', quarter)", "month": "date_format(d, 'yyyy-MM')", "day": "date_format(d, 'yyyy-MM-dd')", "weekday": "day_name", "area": "area", "site": "site",
    "category": "category", "item": "cast(item_key as string)", "family": "substring(maker, 1, 7)", "maker": "maker",
}
MEASURES = {"revenue_c": "sum(total_c)", "units": "sum(quantity)", "transactions": "count(distinct transaction_id)"}
#: Dimensions whose labels are in the order of time; levels of each hierarchy from the coarsest on.
TIME = ("year", "quarter", "month", "day")
HIERARCHIES = {"time": TIME, "location": ("site", "area"), "product": ("category", "item"), "make": ("family", "maker")}
MOST_ROWS, MOST_COLUMNS = 200, 24


@dataclass(frozen=True)
class Question:
    """row and column dimension, measure, values that dimensions are held to (one: a slice, several: a dice), and caps of labels."""

    row: str
    column: str | None = None
    measure: str = "revenue_c"
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    most_rows: int = MOST_ROWS
    most_columns: int = MOST_COLUMNS

    def __post_init__(self) -> None:
        unknown = [d for d in (self.row, self.column, *self.filters) if d is not None and d not in DIMENSIONS]
        if unknown or self.measure not in MEASURES:
            raise ValueError(f"no such dimension or measure: {unknown or self.measure}")
        if self.row == self.column:
            raise ValueError("row and column are different dimensions")
        if any(isinstance(v, str) or not v for v in self.filters.values()):
            raise ValueError("a filter is a dimension and a list of values")

    def drilled(self, way: str, label: str | None = None) -> Question:
        """The question one level down or up the row's hierarchy; down, the row's label becomes a slice, up, the level's slices go."""
        level, step = next((h, h.index(self.row)) for h in HIERARCHIES.values() if self.row in h)
        at = step + {"down": 1, "up": -1}[way]
        if not 0 <= at < len(level):
            raise ValueError(f"no level {way} from {self.row}")
        filters = dict(self.filters)
        if way == "down" and label is not None:
            filters[self.row] = [label]
        if way == "up":
            filters = {d: v for d, v in filters.items() if d not in level[at:]}
        return Question(level[at], self.column if self.column != level[at] else None, self.measure, filters, self.most_rows, self.most_columns)


def _order(df: DataFrame, dimension: str) -> list[Column]:
    return [F.asc("label")] if dimension in TIME else [F.desc("value"), F.asc("label")]


def _placed(totals: DataFrame, dimension: str, most: int) -> DataFrame:
    """label, value and place of the labels kept: the first `most` in time for rows that are times, else the largest."""
    top = totals.orderBy(*_order(totals, dimension)).limit(most)
    # at most `most` rows
    return top.withColumn("place", F.row_number().over(W.orderBy(*_order(top, dimension))))


def answer(mart: Mart, q: Question) -> DataFrame:
    """row_label, row_place, column_label, column_place, value, row_total, column_total, grand_total, all_rows, all_columns; a row for each cell.

    Without a column dimension a row is a label and its value, with null column. all_rows and all_columns count the labels before the
    caps. Columns that are times keep the largest ones, in the order of time. What is broadcast has a row for each label kept.
    """
    dims = [d for d in dict.fromkeys([q.row, q.column, *q.filters]) if d is not None]
    lines = mart.table("t_sales").join(mart.table("t_calendar").select("day_no", "year", "quarter", "day_name"), "day_no")
    lines = lines.select("transaction_id", "quantity", "total_c", *(F.expr(DIMENSIONS[d]).alias(f"dim_{d}") for d in dims))
    for d, values in q.filters.items():
        lines = lines.where(F.col(f"dim_{d}").isin(list(values)))
    row, column = F.col(f"dim_{q.row}"), F.col(f"dim_{q.column}") if q.column else None
    value = F.expr(MEASURES[q.measure]).cast("long").alias("value")
    if column is None:
        sums = lines.groupingSets([[row], []], row).agg(value, F.grouping_id().alias("level")).withColumn("dim_", F.lit(None).cast("string"))
        cells, rows, grand = sums.where("level = 0"), sums.where("level = 0"), sums.where("level = 1")
        columns = None
    else:
        sums = lines.groupingSets([[row, column], [row], [column], []], row, column).agg(value, F.grouping_id().alias("level"))
        cells, rows, columns, grand = (sums.where(F.col("level") == k) for k in (0, 1, 2, 3))
    labelled = lambda df, d: df.select(F.col(f"dim_{d}").alias("label"), "value")
    kept_rows = _placed(labelled(rows, q.row), q.row, q.most_rows).select(F.col("label").alias("row_label"), F.col("place").alias("row_place"), F.col("value").alias("row_total"))
    n_rows = rows.agg(F.count(F.lit(1)).alias("all_rows"))
    out = cells.select(F.col(f"dim_{q.row}").alias("row_label"), (F.col(f"dim_{q.column}") if q.column else F.lit(None).cast("string")).alias("column_label"), "value")
    out = out.join(F.broadcast(kept_rows), "row_label").crossJoin(F.broadcast(n_rows)).crossJoin(F.broadcast(grand.select(F.col("value").alias("grand_total"))))
    if columns is None:
        none = F.lit(None)
        out = out.withColumns({"column_place": none.cast("int"), "column_total": none.cast("long"), "all_columns": F.lit(0).cast("long")})
    else:
        totals = labelled(columns, q.column)
        largest = totals.orderBy(F.desc("value"), F.asc("label")).limit(q.most_columns)
        kept = _placed(largest, q.column, q.most_columns).select(F.col("label").alias("column_label"), F.col("place").alias("column_place"), F.col("value").alias("column_total"))
        out = out.join(F.broadcast(kept), "column_label").crossJoin(F.broadcast(columns.agg(F.count(F.lit(1)).alias("all_columns"))))
    return out.select("row_label", "row_place", "column_label", "column_place", "value", "row_total", "column_total", "grand_total", "all_rows", "all_columns")


QUESTIONS = {
    "Q5_category_by_year": Question("category", "year"),
    "Q5_month_by_site": Question("month", "site", "units", {"category": ["ECONOMY", "STANDARD"]}),
    "Q5_items": Question("item", None, "revenue_c", {"site": ["ASIA"]}),
    "Q5_maker_by_weekday": Question("maker", "weekday", "transactions", {"year": ["1996", "1997"], "site": ["ASIA", "EUROPE"]}),
    "Q5_area_by_month": Question("area", "month", "transactions"),
    "Q6_down_year": Question("year", "site").drilled("down", "1997"),
    "Q6_down_site": Question("site", None, "units", {"year": ["1997"]}).drilled("down", "EUROPE"),
    "Q6_up_day": Question("day", "category", "revenue_c", {"month": ["1997-03"], "day": ["1997-03-05"], "site": ["ASIA"]}).drilled("up"),
}


def _sql(row: str, column: str | None, measure: str, cond: str, row_order: str, column_order: str, rows: int = MOST_ROWS, columns: int = MOST_COLUMNS) -> str:
    lines = f"select *, {row} as r, {column or 'null'} as k from t_sales join t_calendar using (day_no) where {cond}"
    if column is None:
        return f"""with q_lines as ({lines}), q_rows as (select r, {measure} as total, row_number() over (order by {row_order}) as place from (select * from q_lines) group by r)
          select r as row_label, place as row_place, cast(null as varchar) as column_label, cast(null as int) as column_place, total as value, total as row_total, cast(null as bigint) as column_total,
            (select {measure} from q_lines) as grand_total, (select count(*) from q_rows) as all_rows, 0 as all_columns from q_rows where place <= {rows}"""
    return f"""with q_lines as ({lines}), q_cells as (select r, k, {measure} as value from q_lines group by r, k),
      q_rows as (select r, {measure} as total, row_number() over (order by {row_order}) as place from q_lines group by r),
      q_all as (select k, {measure} as total from q_lines group by k), q_top as (select * from q_all order by total desc, k limit {columns}), q_columns as (select *, row_number() over (order by {column_order}) as place from q_top)
      select c.r as row_label, a.place as row_place, c.k as column_label, b.place as column_place, c.value, a.total as row_total, b.total as column_total, (select {measure} from q_lines) as grand_total,
        (select count(*) from q_rows) as all_rows, (select count(*) from q_all) as all_columns
      from q_cells c join q_rows a on a.r = c.r and a.place <= {rows} join q_columns b on b.k = c.k"""


_REVENUE, _UNITS, _TX = "cast(sum(total_c) as bigint)", "cast(sum(quantity) as bigint)", "count(distinct transaction_id)"
SQL = {
    "Q5_category_by_year": _sql("category", "cast(year as varchar)", _REVENUE, "true", "sum(total_c) desc, r", "k"),
    "Q5_month_by_site": _sql("strftime(t_sales.d, '%Y-%m')", "site", _UNITS, "category in ('ECONOMY', 'STANDARD')", "r", "total desc, k"),
    "Q5_items": _sql("cast(item_key as varchar)", None, _REVENUE, "site = 'ASIA'", "sum(total_c) desc, r", ""),
    "Q5_maker_by_weekday": _sql("maker", "day_name", _TX, "year in (1996, 1997) and site in ('ASIA', 'EUROPE')", "count(distinct transaction_id) desc, r", "total desc, k"),
    "Q5_area_by_month": _sql("area", "strftime(t_sales.d, '%Y-%m')", _TX, "true", "count(distinct transaction_id) desc, r", "k"),
    "Q6_down_year": _sql("concat(year, '-Q', quarter)", "site", _REVENUE, "year = 1997", "r", "total desc, k"),
    "Q6_down_site": _sql("area", None, _UNITS, "year = 1997 and site = 'EUROPE'", "sum(quantity) desc, r", ""),
    "Q6_up_day": _sql("strftime(t_sales.d, '%Y-%m')", "category", _REVENUE, "site = 'ASIA'", "r", "total desc, k"),
}
