"""Column groups, business constants and KPI targets.

Every operator in the package takes its column names from a
``FeatureConfig`` so it runs on any binary-outcome customer table; the
defaults describe the telecom attrition layout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
KEY_COL = "CustomerID"
TARGET_COL = "Churn"

CONTRACT_COLS = ["CustomerID", "Tenure", "ContractType", "PaymentMethod", "PaperlessBilling", "Churn"]
DEMOGRAPHIC_COLS = ["CustomerID", "Gender", "SeniorCitizen", "Dependents", "Partner"]
USAGE_COLS = [
    "CustomerID", "MonthlyCharges", "TotalCharges", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]

# Yes/No and Male/Female columns mapped to 1/0 by the cleaning step.
BINARY_MAP_COLS = ["PaperlessBilling", "Dependents", "Partner", "PhoneService", "Gender"]
BINARY_VALUE_MAP = {"Yes": 1, "No": 0, "Male": 1, "Female": 0}
PASSTHROUGH_COLS = ["SeniorCitizen"]

# Stage-4 layout (before feature engineering): 3 numeric, 10 categorical, 6 binary.
PREP_NUMERIC_COLS = ["Tenure", "MonthlyCharges", "TotalCharges"]
PREP_CATEGORICAL_COLS = [
    "ContractType", "PaymentMethod", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies",
]

# Stage-5 layout (after feature engineering): 6 numeric, 11 categorical, 5 binary.
ADDON_SERVICE_COLS = [
    "MultipleLines", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
]
TENURE_EDGES = [-1, 12, 24, 48, 72]
TENURE_LABELS = ["0-12", "12-24", "24-48", "48-72"]
TENURE_OUT_OF_RANGE = "nan"
DROP_WEAK_COLS = ["PhoneService", "HasInternetService"]
FE_NUMERIC_COLS = ["Tenure", "MonthlyCharges", "TotalCharges", "TotalServices", "AvgMonthlySpend", "ChargeDiff"]
FE_CATEGORICAL_COLS = [
    "ContractType", "PaymentMethod", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "TenureBucket",
]
FE_BINARY_COLS = ["PaperlessBilling", "Dependents", "Partner", "Gender", "SeniorCitizen"]

# Subgroups audited for fairness.
FAIRNESS_COLS = ["Gender", "SeniorCitizen", "Partner", "Dependents"]

# Business assumptions.
CLV = 3000
RETENTION_RATE = 0.50
CAMPAIGN_COST_PER_HEAD = 150

# KPI targets (all compared with >=).
KPI_TARGETS = {"recall": 0.75, "roc_auc": 0.85, "precision": 0.50, "f1": 0.60}

# Threshold picker constraints.
MIN_RECALL = 0.75
MIN_PRECISION = 0.50

# Threshold sweep 0.10 ... 0.90 step 0.01 (81 values, generated as floats).
SWEEP_LOW, SWEEP_HIGH, SWEEP_STEP = 0.10, 0.90, 0.01
# Candidate thresholds compared in the evaluation report.
CANDIDATE_THRESHOLDS = [0.45, 0.48, 0.49, 0.50, 0.52, 0.55]
DEPLOYED_THRESHOLD = 0.49
DEFAULT_THRESHOLD = 0.50

# Risk tiers: >= 0.75 Critical, >= threshold High, >= 0.30 Medium, else Low.
CRITICAL_CUTOFF = 0.75
MEDIUM_CUTOFF = 0.30

# Fallback train median of TotalCharges when none is stored.
TOTAL_CHARGES_MEDIAN_FALLBACK = 1397.475

# Disparity flags.
RECALL_GAP_LIMIT = 0.10
SELECTION_GAP_LIMIT = 0.15
FP_SHARE_LIMIT = 40.0
SPECIFICITY_FLOOR = 0.80

# Serving-record validation ranges.
TENURE_RANGE = (0, 120)
MONTHLY_RANGE = (0.0, 500.0)
TOTAL_RANGE = (0.0, 20000.0)

# Hyper-parameter search space.
GRID_C = [0.001, 0.01, 0.1, 0.5, 1, 5, 10]
GRID_L1_RATIO = [0.0, 1.0]
RANDOM_SEARCH_DRAWS = 50
RANDOM_C_RANGE = (1e-3, 10.0)
RANDOM_STATE = 42
N_FOLDS = 5
SPLIT_FRACTIONS = (0.70, 0.15, 0.15)

# Enumerations of the serving schema.
ENUMS = {
    "Gender": ["Male", "Female"],
    "Partner": ["Yes", "No"],
    "Dependents": ["Yes", "No"],
    "ContractType": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": ["Yes", "No"],
    "PaymentMethod": [
        "Electronic check", "Mailed check",
        "Bank transfer (automatic)", "Credit card (automatic)",
    ],
    "MultipleLines": ["Yes", "No", "No phone service"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": ["Yes", "No", "No internet service"],
    "OnlineBackup": ["Yes", "No", "No internet service"],
    "DeviceProtection": ["Yes", "No", "No internet service"],
    "TechSupport": ["Yes", "No", "No internet service"],
    "StreamingTV": ["Yes", "No", "No internet service"],
    "StreamingMovies": ["Yes", "No", "No internet service"],
}
# ---------------------------------------------------------------------------


def sweep_thresholds(low: float = SWEEP_LOW, high: float = SWEEP_HIGH, step: float = SWEEP_STEP) -> list[float]:
    """The sweep grid as the same doubles an ``arange(low, high + step, step)`` yields.

    ``arange`` computes ``low + i * delta`` with ``delta = (low + step) - low``,
    which is why index 39 is 0.48999999999999977 rather than 0.49.
    """
    stop = high + step
    delta = (low + step) - low
    n = math.ceil((stop - low) / step)
    return [low + i * delta for i in range(n)]


@dataclass(frozen=True)
class Costs:
    clv: float = CLV
    retention_rate: float = RETENTION_RATE
    cost_per_head: float = CAMPAIGN_COST_PER_HEAD


@dataclass(frozen=True)
class FeatureConfig:
    """Column groups for one binary-outcome customer table."""

    key: str = KEY_COL
    target: str = TARGET_COL
    binary_map_cols: tuple = tuple(BINARY_MAP_COLS)
    binary_value_map: dict = field(default_factory=lambda: dict(BINARY_VALUE_MAP))
    passthrough_cols: tuple = tuple(PASSTHROUGH_COLS)
    numeric_cols: tuple = tuple(FE_NUMERIC_COLS)
    categorical_cols: tuple = tuple(FE_CATEGORICAL_COLS)
    binary_cols: tuple = tuple(FE_BINARY_COLS)
    addon_cols: tuple = tuple(ADDON_SERVICE_COLS)
    fairness_cols: tuple = tuple(FAIRNESS_COLS)

    @property
    def feature_input_cols(self) -> list[str]:
        return list(self.numeric_cols) + list(self.categorical_cols) + list(self.binary_cols)


# Stage-4 (pre-engineering) configuration.
PREP_CONFIG = FeatureConfig(
    numeric_cols=tuple(PREP_NUMERIC_COLS),
    categorical_cols=tuple(PREP_CATEGORICAL_COLS),
    binary_cols=tuple(BINARY_MAP_COLS + PASSTHROUGH_COLS),
)
# Stage-5 (final) configuration.
FE_CONFIG = FeatureConfig()
