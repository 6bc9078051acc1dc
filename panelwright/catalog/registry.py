"""Registration of named queries and rendering of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.catalog.oracle import with_inputs
from panelwright.plans import panels
from panelwright.session import files_state, stored_by_year
from panelwright.sources import cleaning, covariates, tables


#: Stored tables by application, state of their source files and name.
_STORED: dict[tuple, DataFrame] = {}
_SOURCES = ("lineitem", "orders", "customer", "nation", "part", "supplier", "region")


class Market:
    """The frames one query works on, derived lazily from one folder of tables.

    Facts and panels are stored by year the first time a query of the
    application asks for them, as an ingest would, and read from there while the
    source files stay as they are.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        state = files_state(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in _SOURCES])
        key = (self.spark.sparkContext.applicationId, state, name)
        if key not in _STORED:
            _STORED[key] = stored_by_year(make())
        return _STORED[key]

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    def ref(self, name: str) -> DataFrame:
        return covariates.covariate(self.spark, self.sf_dir, name)

    @cached_property
    def facts(self) -> DataFrame:
        return self._stored("facts", lambda: tables.facts(self.spark, self.sf_dir))

    @cached_property
    def dispatch(self) -> DataFrame:
        return self._stored("dispatch", lambda: tables.dispatch(self.spark, self.sf_dir))

    @cached_property
    def dim_state(self) -> DataFrame:
        return tables.dim_state(self.spark, self.sf_dir)

    @cached_property
    def panel_month(self) -> DataFrame:
        return self._stored("panel_month", lambda: panels.state_month(self.facts))

    @cached_property
    def panel_year(self) -> DataFrame:
        return self._stored("panel_year", lambda: panels.with_changes(panels.state_year_base(self.facts)))

    @cached_property
    def maker_share(self) -> DataFrame:
        return panels.maker_state_share(self.facts)

    @cached_property
    def edges(self) -> DataFrame:
        return panels.oem_state_edges(self.facts)

    @cached_property
    def population(self) -> DataFrame:
        return self.ref("ref_population")

    @cached_property
    def credit(self) -> DataFrame:
        return cleaning.credit_depth(self.ref("ref_loans"), self.population)

    @cached_property
    def cng(self) -> DataFrame:
        return cleaning.sparse_snapshot(
            self.ref("ref_cng"),
            "stations",
            {1999: "1999-05-31", 2000: "2000-03-31"},
            {1999: "complete_state_allocation"},
        )

    @cached_property
    def ev(self) -> DataFrame:
        return cleaning.sparse_snapshot(
            self.ref("ref_ev"),
            "public_chargers",
            {2001: "2001-08-01"},
            {2001: "incomplete_state_allocation"},
        )

    @cached_property
    def tax(self) -> DataFrame:
        return cleaning.lifetime_tax(
            self.ref("ref_tax"), ["Petrol", "Diesel", "CNG", "Strong Hybrid", "EV"]
        )

    @cached_property
    def full_year(self) -> DataFrame:
        populated = panels.with_population(self.panel_year, self.population, 2000)
        covered = panels.with_covariates(
            populated, self.ref("ref_income"), self.ref("ref_gsdp"), self.credit, self.cng, self.ev
        )
        return panels.with_prices(covered, self.ref("ref_prices"))

    @cached_property
    def context(self) -> DataFrame:
        return panels.experiment_state_context(
            self.full_year, self.dim_state, self.tax, self.cng, self.ev, 2000, 1999, 2001
        )

    @cached_property
    def retail_wholesale(self) -> DataFrame:
        return panels.retail_wholesale_month(self.facts, self.dispatch)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    sql: str | None
    digits: int = 6

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return presentable(self.build(Market(spark, sf_dir)), self.digits)


QUERIES: dict[str, Query] = {}


def query(
    name: str,
    sql: str | None = None,
    using: str = "",
    rounded: str = "",
    texts: str = "",
    digits: int = 6,
) -> Callable[[Callable[[Market], DataFrame]], Callable[[Market], DataFrame]]:
    """Registers a query.

    ``using`` names the oracle inputs of ``sql``; ``rounded`` its double columns
    (``digits`` on both sides) and ``texts`` its dates (ISO text on both sides).
    """

    def register(build: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            swaps = [f"round({c}, {digits}) + 0e0 AS {c}" for c in rounded.split()]
            swaps += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
            star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
            text = with_inputs(using.split(), f"SELECT {star} FROM (\n{sql}\n) result")
        QUERIES[name] = Query(name, build, text, digits)
        return build

    return register


def presentable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles, wide integers, dates as ISO text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
