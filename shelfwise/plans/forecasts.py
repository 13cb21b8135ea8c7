"""Demand forecasts of the source tables: search for a model, final models, forecasts with bounds; fitted once as long as the sources stay.

The order of choices: loss and target transform with the first parameters, then parameters, both fitted on all training origins and
judged by the error on all validation origins of the first horizon; then whether origins whose target days had empty shelves are
left out; then, with these choices, models of training origins (bounds, importance), of training and validation origins (test), and of
all origins (forecasts of the future).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, forecasting
from ..operators import tree_boosting as boosting
from ..operators.models import intervals, metrics
from ..sources.io import source_state, stored
from ..sources.roles import SOURCES, roles
from .series import HORIZONS
from .views import Mart

#: Losses and transforms tried, and parameters of trees tried with the better one.
VARIANTS = ({"loss": "squared"}, {"loss": "squared", "log_target": True}, {"loss": "poisson"})
GRID = (
    {"rate": 0.10, "rounds": 200, "leaves": 31, "least_rows": 100, "l2": 0.0},
    {"rate": 0.05, "rounds": 300, "leaves": 63, "least_rows": 200, "l2": 1.0},
    {"rate": 0.10, "rounds": 200, "leaves": 15, "least_rows": 400, "l2": 1.0},
    {"rate": 0.05, "rounds": 400, "leaves": 31, "least_rows": 100, "l2": 5.0},
)
STRATEGIES = ("all", "uncensored")
KEYS = ["site_key", "site", "maker", "family", "day_no"]
REPEATS = 3


def origins(mart: Mart) -> DataFrame:
    """Features and, for each horizon, target, censored days and period of every origin with enough history."""
    last = mart.table("t_calendar").agg(F.max("day_no").alias("last_day"))
    rows = mart.table("v_features").where(F.col("n_seen") >= forecasting.HISTORY).crossJoin(F.broadcast(last))
    test = F.col("last_day") - forecasting.TEST_DAYS
    validation = test - forecasting.TEST_DAYS

    def period(h: int) -> Column:
        end = F.col("day_no") + h
        return F.when(end <= validation, "train").when((F.col("day_no") > validation) & (end <= test), "validation").when((F.col("day_no") > test) & (end <= F.col("last_day")), "test").alias(f"period_{h}")

    return rows.select(*KEYS, *(c for c in forecasting.FEATURES if c not in KEYS), *(f"{c}_{h}" for h in HORIZONS for c in ("target", "censored")), *map(period, HORIZONS), "last_day")


def uses() -> dict[str, Column]:
    """Which origins each fit may use, by name."""
    out = {}
    for h in HORIZONS:
        period = F.col(f"period_{h}")
        for strategy in STRATEGIES:
            on = F.col(f"target_{h}").isNotNull() & (F.lit(strategy == "all") | (F.col(f"censored_{h}") == 0))
            out |= {f"train_{h}_{strategy}": on & (period == "train"), f"known_{h}_{strategy}": on & period.isin("train", "validation"), f"every_{h}_{strategy}": on}
    return out


@dataclass
class Forecasts:
    """Fits of one mart; each stage runs when it is first asked for."""

    mart: Mart

    def __post_init__(self) -> None:
        self.kept: dict = {}

    def _once(self, name: str, make):
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    @property
    def rows(self) -> DataFrame:
        return self._once("rows", lambda: origins(self.mart))

    def fit(self, specs: list[boosting.Spec]) -> list[boosting.Model]:
        features, targets, named = forecasting.FEATURES, [f"target_{h}" for h in HORIZONS], uses()
        edges = self._once("edges", lambda: boosting.bin_edges(self.rows, features))
        blocks = self._once("blocks", lambda: boosting.row_blocks(self.rows, features, targets, named, edges))
        return boosting.fit(blocks, features, edges, targets, list(named), specs)

    def period(self, h: int, name: str) -> DataFrame:
        return self.rows.where(F.col(f"period_{h}") == name).withColumn("target", F.col(f"target_{h}"))

    def scored(self, model: boosting.Model, h: int, name: str) -> DataFrame:
        """KEYS, target and predicted of the origins of a period."""
        rows = self.period(h, name).withColumn("censored", F.col(f"censored_{h}"))
        return boosting.predict(model, rows, [*KEYS, "target", "censored"])

    def _wape(self, model: boosting.Model) -> float:
        return metrics(self.scored(model, HORIZONS[0], "validation"), []).first()["wape"]

    @property
    def search(self) -> list[tuple]:
        """(stage, loss, log_target, number of parameters, validation error, chosen) of all that was tried."""

        def run() -> list[tuple]:
            base = boosting.Spec(target=f"target_{HORIZONS[0]}", use=f"train_{HORIZONS[0]}_all", **GRID[0])
            variants = [replace(base, **v) for v in VARIANTS]
            fitted = [*self.fit(variants)]
            found = [("variant", s.loss, s.log_target, 0, self._wape(m)) for s, m in zip(variants, fitted)]
            best = min(found, key=lambda x: x[4])
            grids = [replace(base, loss=best[1], log_target=best[2], **g) for g in GRID[1:]]
            fitted += self.fit(grids)
            found += [("parameters", s.loss, s.log_target, k, self._wape(m)) for k, (s, m) in enumerate(zip(grids, fitted[len(variants) :]), 1)]
            least = min(x[4] for x in found if x[1:3] == best[1:3])
            out = [(*x, x[1:3] == best[1:3] and x[4] == least) for x in found]
            self.kept["searched"] = fitted[[x[-1] for x in out].index(True)]
            return out

        return self._once("search", run)

    @property
    def spec(self) -> boosting.Spec:
        _, loss, log_target, k, *_ = next(x for x in self.search if x[-1])
        return boosting.Spec(target="", use="", loss=loss, log_target=log_target, **GRID[k])

    @property
    def strategies(self) -> dict[str, boosting.Model]:
        """Models of the training origins of the first horizon with and without censored targets; with them it is the search's own.

        If no training origin has a censored target, both are fitted on the same rows, so one model stands for both.
        """

        def run() -> dict[str, boosting.Model]:
            h, spec = HORIZONS[0], self.spec
            on = uses()
            left_out = self.rows.agg(F.count_if(on[f"train_{h}_all"] & ~F.coalesce(on[f"train_{h}_uncensored"], F.lit(False)))).first()[0]
            apart = {"uncensored": self.fit([replace(spec, target=f"target_{h}", use=f"train_{h}_uncensored")])[0]} if left_out else {}
            return dict.fromkeys(STRATEGIES, self.kept["searched"]) | apart

        return self._once("strategies", run)

    def strategy_errors(self) -> DataFrame:
        h = HORIZONS[0]
        parts = []
        for name, model in self.strategies.items():
            scored = self.scored(model, h, "validation")
            parts += [metrics(scored.where(on).withColumns({"strategy": F.lit(name), "origins": F.lit(which)}), ["strategy", "origins"]) for which, on in (("all", F.lit(True)), ("uncensored", F.col("censored") == 0))]
        return reduce(DataFrame.unionByName, parts)

    @property
    def strategy(self) -> str:
        """The one with less error on uncensored validation origins, which show demand; all in a tie or without such origins."""

        def choose() -> str:
            wape = {r["strategy"]: r["wape"] for r in self.strategy_errors().where("origins = 'uncensored'").collect()}
            return "uncensored" if (wape.get("uncensored") or float("inf")) < (wape.get("all") or float("inf")) else "all"

        return self._once("strategy", choose)

    def models(self, kinds: tuple[str, ...], horizons: tuple[int, ...] = HORIZONS) -> dict[tuple[str, int], boosting.Model]:
        """(train, known or every; horizon) -> model, with all choices made; of those asked for, the ones not fitted yet grow in the same passes."""
        made = self._once("models", lambda: {("train", HORIZONS[0]): self.strategies[self.strategy]})
        wanted = [(kind, h) for h in horizons for kind in kinds if (kind, h) not in made]
        if wanted:
            specs = [replace(self.spec, target=f"target_{h}", use=f"{kind}_{h}_{self.strategy}") for kind, h in wanted]
            made |= dict(zip(wanted, self.fit(specs)))
        return made

    def bounded(self, h: int, rows: DataFrame) -> DataFrame:
        """rows (with `predicted`) and bounds from the residuals of the validation origins, predicted by the model of training origins."""
        return intervals(self.scored(self.models(("train",))["train", h], h, "validation"), rows)

    def test(self, h: int) -> DataFrame:
        return self.scored(self.models(("known",))["known", h], h, "test")

    def future(self, h: int) -> DataFrame:
        """Forecasts of every series from the last day on."""
        last = self.rows.where(F.col("day_no") == F.col("last_day"))
        return self.bounded(h, boosting.predict(self.models(("train", "every"))["every", h], last, KEYS))

    def forecasts(self) -> DataFrame:
        """Rows as decisions take them, as of the last day."""
        return reduce(DataFrame.unionByName, (self.future(h).select("site_key", "maker", F.lit(h).alias("horizon"), F.col("predicted").alias("point"), F.col("lower_bound").alias("lower"), F.col("upper_bound").alias("upper")) for h in HORIZONS))


_FITTED: dict[tuple, Forecasts] = {}


def forecasts_of(spark: SparkSession, sf_dir: str) -> Forecasts:
    key = spark.sparkContext.applicationId, sf_dir, source_state(spark, [f"{sf_dir}/{t}.parquet" for t in SOURCES])
    if key not in _FITTED:
        for old in [k for k in _FITTED if k[:2] == key[:2]]:
            del _FITTED[old]
        _FITTED[key] = Forecasts(Mart(roles(spark, sf_dir)))
    return _FITTED[key]


def _each_horizon(make) -> DataFrame:
    return reduce(DataFrame.unionByName, (make(h).withColumn("horizon", F.lit(h)) for h in HORIZONS))


def h7_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the final models on all test origins, whole and by family, for each horizon."""
    f = forecasts_of(spark, sf_dir)
    return _each_horizon(lambda h: metrics(f.test(h).withColumn("part", F.explode(F.array(F.lit("all"), F.col("family")))), ["part"]))


def h8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(stage, loss, log_target, k, *(GRID[k][c] for c in ("rate", "rounds", "leaves", "least_rows", "l2")), wape, chosen) for stage, loss, log_target, k, wape, chosen in forecasts_of(spark, sf_dir).search]
    return spark.createDataFrame(rows, "stage string, loss string, log_target boolean, parameters int, rate double, rounds int, leaves int, least_rows int, l2 double, wape double, chosen boolean")


def h9_censoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts_of(spark, sf_dir)
    return f.strategy_errors().withColumn("chosen", F.col("strategy") == f.strategy)


def h10_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test origin by the models of training and validation origins, and the future by those of all origins; with bounds."""
    f = forecasts_of(spark, sf_dir)
    f.models(("train", "known", "every"))
    columns = ["site", "maker", "day_no", "target", "predicted", "lower_bound", "upper_bound", "period"]

    def one(h: int) -> DataFrame:
        test = f.bounded(h, f.test(h)).withColumn("period", F.lit("test"))
        return test.select(*columns).unionByName(f.future(h).withColumns({"target": F.lit(None).cast("double"), "period": F.lit("future")}).select(*columns))

    return _each_horizon(one)


def h12_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test origins by bin of the prediction, and the share of them within the bounds."""
    f = forecasts_of(spark, sf_dir)
    f.models(("train", "known"))
    inside = F.avg(F.col("target").between(F.col("lower_bound"), F.col("upper_bound")).cast("int")).alias("coverage")
    return _each_horizon(lambda h: f.bounded(h, f.test(h)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), inside))


def h13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise of the mean absolute error over all validation origins of the first horizon when a feature's values change rows."""
    f = forecasts_of(spark, sf_dir)
    h = HORIZONS[0]
    return boosting.permutation_importance(f.models(("train",), HORIZONS[:1])["train", h], f.period(h, "validation"), REPEATS)


def y10_model_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action queue from the fitted models' forecasts and bounds."""
    f = forecasts_of(spark, sf_dir)
    day = decisions.decision_day(f.mart, 0)
    queue = decisions.decide(decisions.pair_state(f.mart, day), decisions.live_lots(f.mart, day), stored(f.forecasts(), "forecasts")).queue
    return queue.select("position", "priority", "site", "maker", "stock", "cover_days", "f7", "upper7", "f14", "f30", "risk", "reorder_status", "order_quantity", "overstock_status", "pair_expiry_risk", "primary_action", "primary_reason", "secondary_reasons", "exposure_c", "score")


#: in the order in which their fits build on each other
QUERIES = {
    "H8_parameter_search": h8_search, "H9_censoring": h9_censoring, "H7_boosted_model": h7_model, "H10_forecasts": h10_forecasts, "H12_intervals": h12_intervals, "H13_importance": h13_importance,
    "Y10_model_queue": y10_model_queue,
}
