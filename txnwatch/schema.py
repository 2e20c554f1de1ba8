"""Column names, fixed values and schemas shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# ---------------------------------------------------------------------------
# Fixed values that must equal the published pipeline's for the same results.
# ---------------------------------------------------------------------------
DAY_SECONDS = 86400
WEEK_SECONDS = 7 * DAY_SECONDS
TS_PATTERN = "yyyy/MM/dd HH:mm"
BLOCK_BEGIN = "BEGIN LAUNDERING ATTEMPT"
BLOCK_END = "END"
PAY_FORMATS = ["ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Reinvestment", "Wire"]
JOIN_KEYS = ["ts", "from_bank", "from_account", "to_bank", "to_account",
             "amount_paid", "payment_currency", "payment_format"]
BEHAVIOUR_FEATURES = ["amount_paid", "sender_24h_count", "sender_24h_volume", "amt_vs_7d_avg",
                      "unique_receivers_24h", "is_round_1000", "rapid_exit_risk"]
CHECK_FEATURES = BEHAVIOUR_FEATURES + ["is_interbank"]
SAFE_EPS = 1e-6
SEED = 42
N_NEGATIVES = 2_000_000
TARGET_RECALL = 0.75
TOP_ALERTS = 1000
PRECISION_AT = (100, 1000, 5000)
# Rule thresholds (nominal, mixed currencies).
LARGE_AMOUNT = 10_000
VELOCITY_COUNT = 3
ROUND_UNIT = 1000
INTERBANK_AMOUNT = 5_000
# Raw transaction CSV: eleven columns bound by position (the header repeats a name).
TRANSACTION_CSV_SCHEMA = StructType([
    StructField("ts_raw", StringType()),
    StructField("from_bank", StringType()),
    StructField("from_account", StringType()),
    StructField("to_bank", StringType()),
    StructField("to_account", StringType()),
    StructField("amount_received", DoubleType()),
    StructField("receiving_currency", StringType()),
    StructField("amount_paid", DoubleType()),
    StructField("payment_currency", StringType()),
    StructField("payment_format", StringType()),
    StructField("label", IntegerType()),
])

# Pattern-file records: the first ten CSV fields, all kept as text until cast.
PATTERN_RECORD_COLUMNS = [f.name for f in TRANSACTION_CSV_SCHEMA.fields[:10]]
# ---------------------------------------------------------------------------


def pay_column(category: str) -> str:
    """One-hot column name: lower case, spaces to underscores."""
    return "pay_" + category.lower().replace(" ", "_")


@dataclass(frozen=True)
class TxnColumns:
    """Names of the canonical transaction columns; every operator takes one."""

    txn_id: str = "txn_id"
    ts: str = "ts"
    sender: str = "from_account"
    receiver: str = "to_account"
    sender_bank: str = "from_bank"
    receiver_bank: str = "to_bank"
    amount: str = "amount_paid"
    payment_format: str = "payment_format"
    label: str = "label"
    typology: str = "typology"


@dataclass(frozen=True)
class FeatureSpec:
    """What the feature stage computes; defaults are the published pipeline's."""

    short_window: int = DAY_SECONDS
    long_window: int = WEEK_SECONDS
    pay_formats: tuple = tuple(PAY_FORMATS)
    cols: TxnColumns = field(default_factory=TxnColumns)

    def model_features(self, include_interbank: bool = False) -> list[str]:
        feats = list(BEHAVIOUR_FEATURES) + [pay_column(p) for p in self.pay_formats]
        return feats + (["is_interbank"] if include_interbank else [])

