"""The canonical vocabulary: which filed tags mean which metric, in order of preference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric, kind, unit, and the us-gaap / dei tags that may carry it, best first.
METRICS = [
    ("revenue", "DURATION", "USD", ["RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet", "SalesRevenueServicesNet", "TotalRevenuesAndOtherIncome"]),
    ("cost_of_revenue", "DURATION", "USD", ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices"]),
    ("gross_profit", "DURATION", "USD", ["GrossProfit"]),
    ("operating_income", "DURATION", "USD", ["OperatingIncomeLoss"]),
    ("pretax_income", "DURATION", "USD", ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"]),
    ("tax_expense", "DURATION", "USD", ["IncomeTaxExpenseBenefit"]),
    ("interest_expense", "DURATION", "USD", ["InterestExpense", "InterestExpenseDebt", "InterestIncomeExpenseNet"]),
    ("net_income", "DURATION", "USD", ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"]),
    ("eps_diluted", "DURATION", "USD/shares", ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"]),
    ("eps_basic", "DURATION", "USD/shares", ["EarningsPerShareBasic", "EarningsPerShareBasicAndDiluted"]),
    ("shares_diluted", "DURATION", "shares", ["WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic"]),
    ("depreciation_amortization", "DURATION", "USD", ["DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "Depreciation"]),
    ("total_assets", "INSTANT", "USD", ["Assets"]),
    ("current_assets", "INSTANT", "USD", ["AssetsCurrent"]),
    ("total_liabilities", "INSTANT", "USD", ["Liabilities"]),
    ("current_liabilities", "INSTANT", "USD", ["LiabilitiesCurrent"]),
    ("total_equity", "INSTANT", "USD", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    ("cash", "INSTANT", "USD", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]),
    ("short_term_investments", "INSTANT", "USD", ["ShortTermInvestments", "MarketableSecuritiesCurrent", "AvailableForSaleSecuritiesDebtSecuritiesCurrent"]),
    ("inventory", "INSTANT", "USD", ["InventoryNet"]),
    ("receivables", "INSTANT", "USD", ["AccountsReceivableNetCurrent", "ReceivablesNetCurrent"]),
    ("shares_outstanding", "INSTANT", "shares", ["CommonStockSharesOutstanding", "CommonStockSharesIssued", "EntityCommonStockSharesOutstanding"]),
    ("short_term_debt", "INSTANT", "USD", ["LongTermDebtCurrent", "DebtCurrent", "ShortTermBorrowings", "OtherShortTermBorrowings"]),
    ("long_term_debt", "INSTANT", "USD", ["LongTermDebtNoncurrent", "LongTermDebt", "LongTermNotesPayable"]),
    ("operating_cash_flow", "DURATION", "USD", ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]),
    ("capex", "DURATION", "USD", ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets", "PaymentsForCapitalImprovements"]),
    ("dividends_paid", "DURATION", "USD", ["PaymentsOfDividendsCommonStock", "PaymentsOfDividends"]),
    ("buybacks", "DURATION", "USD", ["PaymentsForRepurchaseOfCommonStock"]),
]
EPS_TAGS = ["EarningsPerShareDiluted", "EarningsPerShareBasic", "EarningsPerShareBasicAndDiluted"]
SIC_RANGES = [
    (100, 999, "Agriculture & Forestry", "agriculture"), (1000, 1499, "Mining & Energy", "mining-energy"), (1500, 1799, "Construction", "construction"),
    (2000, 3999, "Manufacturing", "manufacturing"), (4000, 4999, "Transport & Utilities", "transport-utilities"), (5000, 5199, "Wholesale trade", "wholesale"),
    (5200, 5999, "Retail trade", "retail"), (6000, 6799, "Finance & Real estate", "finance"), (7000, 8999, "Services", "services"), (9100, 9999, "Public administration", "public-admin"),
    (2833, 2836, "Biotech & Pharma", "biotech-pharma"), (3570, 3579, "Computer hardware", "computer-hardware"), (3661, 3699, "Electronics & Comms", "electronics"),
    (3674, 3674, "Semiconductors", "semiconductors"), (7370, 7379, "Software & IT services", "software"), (8000, 8099, "Healthcare services", "healthcare"),
    (6020, 6199, "Banking", "banking"), (6311, 6411, "Insurance", "insurance"), (6500, 6599, "Real estate", "real-estate"), (6798, 6798, "REITs", "reits"),
]
MCAP_BANDS = [("mega", 200e9, None), ("large", 10e9, 200e9), ("mid", 2e9, 10e9), ("small", 300e6, 2e9), ("micro", None, 300e6)]


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """A VALUES relation that Spark and DuckDB both read."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


METRICS_SQL = values_sql([(m, k, u) for m, k, u, _ in METRICS], ["metric", "kind", "unit"])
CONCEPTS_SQL = values_sql([(m, k, u, c, i) for m, k, u, tags in METRICS for i, c in enumerate(tags)], ["metric", "kind", "unit", "concept", "priority"])
SIC_SQL = values_sql(SIC_RANGES, ["lo", "hi", "sector", "sector_slug"])


def concept_map(spark: SparkSession) -> DataFrame:
    return spark.sql(CONCEPTS_SQL)


def metrics(spark: SparkSession) -> DataFrame:
    return spark.sql(METRICS_SQL)


def sic_ranges(spark: SparkSession) -> DataFrame:
    return spark.sql(SIC_SQL)
