"""Tables, tags and constants of the fact model."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T

FACTS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("fiscal_period_end", T.DateType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("filed_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
        T.StructField("is_restatement", T.BooleanType()),
        T.StructField("taxonomy", T.StringType()),
    ]
)
FACT_COLUMNS = FACTS.fieldNames()

# Tags measured over a period, tags of an instant, annual forms.
FLOW_TAGS = [
    "NetIncomeLoss",
    "NetCashProvidedByUsedInOperatingActivities",
    "Revenues",
    "SalesRevenueNet",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "GrossProfit",
    "CostOfRevenue",
    "CostOfGoodsAndServicesSold",
    "IncomeTaxExpenseBenefit",
    "InterestExpense",
    "WeightedAverageNumberOfSharesOutstandingBasic",
    "EBIT",
]
INSTANT_TAGS = [
    "Assets",
    "AssetsCurrent",
    "Liabilities",
    "LiabilitiesCurrent",
    "LongTermDebtNoncurrent",
    "RetainedEarningsAccumulatedDeficit",
    "StockholdersEquity",
    "CommonStockSharesOutstanding",
    "EntityCommonStockSharesOutstanding",
]
TAGS = FLOW_TAGS + INSTANT_TAGS
MIN_ANNUAL_DAYS = 300
ANNUAL_FORM_PREFIXES = ("10-K",)
ANNUAL_FORMS = ("DFP", "DART-ANNUAL", "BSE-ANNUAL")

SHARE_TOLERANCE = 0.02
MIN_SECTOR_SIZE = 5
MIN_NAMES_PER_BUCKET = 5
N_BUCKETS = 10
LASSO_ALPHAS = (0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.1)
LASSO_CV_SPLITS = 5
MIN_TRAIN_MONTHS = 18
N_DSR_TRIALS = 4
FORWARD_MONTHS = 6
ROLLING_WINDOW = 24
MIN_STATS_MONTHS = 24
FILING_TOLERANCE_DAYS = 180

SCORES = ["f_score", "z_score", "o_score"]
FEATURES = [f"{s}_z" for s in SCORES]


@dataclass(frozen=True)
class Universe:
    """A market that is ranked on its own.  Outputs are partitions by name and mode."""

    name: str
    currency: str
    suffix: str = ""
    n_buckets: int = N_BUCKETS
    start: dt.date = dt.date(2012, 1, 1)
    end: dt.date = dt.date(2025, 12, 31)
    has_membership: bool = False
    backtestable: bool = True
    corrected: bool = field(default=False)

    @property
    def mode(self) -> str:
        return "corrected" if self.corrected else "static"

    def with_membership(self) -> Universe:
        """The twin that only ranks names while they were members."""
        if not self.has_membership:
            raise ValueError(f"{self.name} has no membership history")
        return Universe(**{**self.__dict__, "corrected": True})


UNIVERSES = {
    u.name: u
    for u in (
        Universe("sp500", "USD", has_membership=True),
        Universe("russell3000", "USD"),
        Universe("kospi", "KRW", ".KS", 5, dt.date(2016, 7, 31), has_membership=True),
        Universe("india", "INR", ".NS", 5, dt.date(2024, 5, 31), backtestable=False),
    )
}
