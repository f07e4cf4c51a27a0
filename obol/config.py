"""Configuration: column groups and rule constants.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(cut points, labels, lists, limits); it is stated plainly and in natural
order.  Everything else is our own naming.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Column groups of the canonical loan schema (our snake_case names)
# --------------------------------------------------------------------------
KEY = "serial_number"
CLIENT = "id"
DATE = "application_date"
LABEL = "default_flag"

OVERDUE_COLS = [f"o{i}" for i in range(8)]  # in time order, o0 = before month 1

# Groups over the eight overdue periods.  o4 belongs to neither early nor late.
EARLY = ["o0", "o1", "o2", "o3"]
LATE = ["o5", "o6", "o7"]
CRITICAL = ["o2", "o3", "o4", "o5"]
WARNING = ["o0", "o1", "o2"]

MISSING_LEVEL = "(missing)"
OTHER_LEVEL = "other"

# ==========================================================================
# FIXED VALUES (must equal the reproduced behaviour)
# ==========================================================================
CATEGORICAL_FEATURES = ["post_res", "main_business", "residence_status", "education", "product"]

NUMERIC_FEATURES = [
    "month_salary", "job_tenure", "payment_progress_ratio", "job_stable",
    "address_match", "residence_stable", "dti_ratio", "payment_pressure",
    "is_new_customer", "historical_default", "prev_overdue_days", "prev_payment_ratio",
    "cumulative_loans", "cumulative_defaults", "customer_default_rate",
    "total_overdue_count", "has_overdue", "early_overdue_count",
    "late_overdue_count", "overdue_worsening", "max_overdue_in_month", "overdue_std",
    "overdue_consistency", "overdue_frequency", "overdue_freq_ratio",
    "recent_overdue_severity", "max_consecutive_overdue",
    "overdue_acceleration", "critical_period_overdue", "late_stage_persistence",
    "late_stage_persistent_flag", "overdue_recovery", "overdue_improving",
    "early_warning_score", "early_warning_flag", "ema_overdue",
    "loan_term", "paid_installments",
]

OPTIONAL_FEATURES = [
    "loan_amount", "monthly_payment", "debt_to_income_ratio",
    "payment_to_income_ratio", "credit_score", "default_prob",
]


# Upload contract: required columns (reject when missing) and optional columns
# (added with default 0 and a warning), in our column names
REQUIRED_UPLOAD_COLUMNS = ["loan_term", "paid_installments", "post_res", "education", "main_business",
                           "job_tenure", "month_salary", "post_perm", "residence_status", "product"]
OPTIONAL_UPLOAD_COLUMNS = ["o0", "o1", "o2", "o3", "o4", "o5", "o6", "o7",
                           "debt_to_income_ratio", "payment_to_income_ratio"]
INTERNAL_RESULT_COLUMNS = ["predicted_default", "predicted_default_optimal", "threshold_difference"]

# Label by bucket list (second labelling rule)
DEFAULT_BUCKETS = ["M1-1", "M1-2", "M2", "M3", "M4", "M5", "M6"]

# Smoothing floor for WoE shares, IV strength cuts (strictly greater than)
WOE_FLOOR = 0.0001
IV_STRONG, IV_MEDIUM, IV_WEAK = 0.3, 0.1, 0.02
IV_SELECT_THRESHOLD = 0.02

TARGET_SMOOTHING = 1.0
GEO_MIN_SAMPLES = 10          # postcode; city uses 5x this
GEO_CITY_FACTOR = 5
CITY_PREFIX_LEN = 3
# residential risk level: right-closed bins (0,.03] (.03,.06] (.06,.10] (.10,1]
RISK_LEVEL_EDGES = [0.0, 0.03, 0.06, 0.10, 1.0]
RISK_LEVEL_LABELS = ["low", "medium", "high", "very_high"]
ADDRESS_WEIGHT, RES_RISK_WEIGHT = 0.3, 0.7

EMA_ALPHA = 0.3
ROLLING_WINDOW = 3
EARLY_WARNING_MIN = 3
LATE_PERSIST_MIN = 2

# residence codes counted as stable (one configured code set)
STABLE_RESIDENCE = ["owned", "spouse", "family"]

# Code tables of uploads: what a user may write in English, and the value the
# models know; one table for all four columns
CODE_COLUMNS = ["education", "residence_status", "main_business", "product"]
CODES = {
    # education
    "Grad+": "研究所以上", "Master": "碩士", "College/Univ": "專科/大學", "University": "大學", "College": "專科",
    "HS/Voc": "高中/職", "High School": "高中", "Elementary": "小學", "Other": "其他",
    # residence status
    "Owned": "自有", "Rented": "租屋", "Spouse": "配偶", "Family": "親屬", "Dormitory": "宿舍",
    # main business
    "Manufacturing": "製造業", "Services": "服務業", "Commerce": "商業", "Tech": "科技業", "Finance": "金融業",
    "Insurance": "保險業", "Securities": "證券及期貨業", "Gov/Education": "公教人員", "Military": "軍人", "F&B": "餐飲業",
    "Transport": "運輸業", "Construction": "營造業", "Real Estate": "不動產業", "Warehousing": "倉儲業", "Telecom": "通信業",
    "Utilities": "水電燃氣業", "Agriculture": "農牧林漁", "Fishery": "漁業", "Mining": "礦業及土石採取業",
    "Professional": "專業人士", "Freelance": "自由業", "E-commerce": "網拍業", "Student": "學生", "Homemaker": "家管",
    "Social/Personal": "社會團體即個人服務",
    # product
    "Beauty": "瘦身美容", "3C/Appliance": "3C家電", "Personal": "個人用品",
}
# Codes each column accepts, as the models know them
ALLOWED_CODES = {
    "education": ["研究所以上", "碩士", "專科/大學", "大學", "專科", "高中/職", "高中", "小學", "其他"],
    "residence_status": ["自有", "租屋", "配偶", "親屬", "宿舍"],
    "main_business": ["製造業", "服務業", "商業", "科技業", "金融業", "保險業", "證券及期貨業", "公教人員", "軍人", "餐飲業", "運輸業",
                      "營造業", "不動產業", "倉儲業", "通信業", "水電燃氣業", "農牧林漁", "漁業", "礦業及土石採取業", "專業人士",
                      "自由業", "網拍業", "學生", "家管", "社會團體即個人服務", "其他"],
    "product": ["瘦身美容", "3C家電", "個人用品", "其他"],
}
# Output tables: grades and actions in the users' second language
GRADE_CODES = {"A (Excellent)": "A (優良)", "B (Moderate)": "B (中等)", "C (Warning)": "C (警戒)", "D (Poor)": "D (不良)",
               "E (Critical)": "E (危險)"}
ACTION_CODES = {
    "Normal Monitoring": "正常監控", "Watch List": "關注名單", "Early Warning": "早期預警", "Enhanced Monitoring": "加強監控",
    "Deterioration Alert": "惡化警示", "Immediate Intervention": "立即介入", "Forced Collection": "強制催收",
    "Enhanced Monitoring + Early Warning": "加強監控+早期預警", "Enhanced Monitoring / Collection Prep": "加強監控/催收準備",
    "Immediate Collection": "立即催收", "Immediate Intervention / Collection Prep": "立即介入/催收準備",
}

# clip bounds of ratio features
DTI_CLIP = (0.0, 2.0)
PTI_CLIP = (0.0, 1.0)

# Scoring thresholds
STANDARD_THRESHOLD = 0.5
FALLBACK_THRESHOLD = 0.5
GRADE_CUTS = [60, 40, 20]  # B, C, D lower bounds of risk_score; A uses (1 - t*) * 100
GRADES = ["A (Excellent)", "B (Moderate)", "C (Warning)", "D (Poor)", "E (Critical)"]
ALERTS = ["LOW RISK", "MEDIUM-HIGH RISK", "HIGH RISK", "VERY HIGH RISK", "CRITICAL RISK"]
RISK_LABELS = ["Very Low Risk", "Moderate Risk", "High Risk", "Very High Risk", "Critical Risk"]

ACT_NORMAL = "Normal Monitoring"
ACT_WATCH = "Watch List"
ACT_EARLY = "Early Warning"
ACT_ENHANCED = "Enhanced Monitoring"
ACT_DETERIORATION = "Deterioration Alert"
ACT_INTERVENE = "Immediate Intervention"
ACT_FORCED = "Forced Collection"
ACT_ENHANCED_EARLY = "Enhanced Monitoring + Early Warning"
ACT_ENHANCED_PREP = "Enhanced Monitoring / Collection Prep"
ACT_COLLECT_NOW = "Immediate Collection"
ACT_INTERVENE_PREP = "Immediate Intervention / Collection Prep"

# Score-band grade (inclusive integer bands; a score in no band is BAD)
SCORE_BANDS = [("EXCELLENT", 80, 100), ("GOOD", 60, 79), ("FAIR", 40, 59), ("POOR", 20, 39), ("BAD", 0, 19)]
GOOD_BAD_THRESHOLD = 0.5

# Risk-adjusted score
SCORE_MIN, SCORE_MAX = 300, 850
AGE_ADJUSTMENTS = [(25, 0.15), (35, 0.05), (50, 0.00), (65, -0.05), (None, 0.10)]  # age <= bound
EMPLOYMENT_MULTIPLIERS = {1: 1.0, 2: 1.2, 3: 1.5, 4: 2.0}  # unknown -> 1.0
EDUCATION_ADJUSTMENTS = {1: 0.20, 2: 0.10, 3: 0.00, 4: -0.05, 5: -0.10}  # unknown -> 0.0

# Client eligibility limits
MIN_AGE, MAX_AGE = 18, 75
MIN_INCOME = 20000
MAX_DTI = 0.5
MIN_CREDIT_HISTORY_MONTHS = 6

# Model report recommendation cuts on AUC
REPORT_AUC_GOOD, REPORT_AUC_FAIR = 0.85, 0.75

# Threshold search grid: numpy-style arange(0.1, 0.9, 0.01) -> start + i * delta
THRESHOLD_START, THRESHOLD_STEP, THRESHOLD_COUNT = 0.1, 0.01, 80
F_BETA = 2.0

# Client-table feature engineering
AGE_BINS = [0, 25, 35, 45, 55, 100]
AGE_BIN_LABELS = ["Young", "Young_Adult", "Middle_Age", "Mature", "Senior"]
INCOME_QUINTILE_LABELS = ["Low", "Lower_Mid", "Mid", "Upper_Mid", "High"]
LOAN_SIZE_LABELS = ["Small", "Medium", "Large"]
OUTLIER_IQR_MULTIPLIER = 1.5
OUTLIER_COLUMNS = ["annual_income", "loan_amount", "debt_to_income_ratio"]
ZSCORE_THRESHOLD = 3.0

# Tuned parameters of the three base learners (boosted trees with 200 and 300
# trees, the third model as a forest), and what stands for them in Spark ML:
# minimum child weight or samples -> minInstancesPerNode, column share ->
# featureSubsetStrategy, border count -> maxBins.  L1/L2 penalties, gamma and
# the number of leaves have no counterpart.  BALANCED learners weigh classes.
MODEL_PARAMS = {
    "GBT_shallow": dict(maxIter=200, maxDepth=4, stepSize=0.013981453819938056, subsamplingRate=0.6250003507025707,
                        featureSubsetStrategy="0.9027543096864294", minInstancesPerNode=7),
    "GBT_deep": dict(maxIter=300, maxDepth=7, stepSize=0.0365147451907443, subsamplingRate=0.8421943199124751,
                     featureSubsetStrategy="0.6562728325260756", minInstancesPerNode=20),
    "RandomForest": dict(numTrees=100, maxDepth=8, maxBins=254),
}
BALANCED = ["GBT_deep", "RandomForest"]

# Randomised search: draws, and one space a learner
SEARCH_DRAWS = 20
SEARCH_SPACES = {
    "GBT_shallow": {"maxIter": [100, 200, 300], "maxDepth": [3, 4, 5, 6], "stepSize": [0.01, 0.1, 0.2],
                    "subsamplingRate": [0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.8", "0.9", "1.0"], "minInstancesPerNode": [1, 3, 5]},
    "GBT_deep": {"maxIter": [100, 200, 300], "maxDepth": [3, 4, 5, 6], "stepSize": [0.01, 0.1, 0.2],
                 "subsamplingRate": [0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.8", "0.9", "1.0"], "minInstancesPerNode": [10, 20, 30]},
    "RandomForest": {"numTrees": [100, 200, 300], "maxDepth": [3, 4, 5, 6], "maxBins": [32, 64, 128]},
}

# Joint sweep: runs, SMOTE ratio, and the drawn settings (pairs are ranges,
# (low, high, "log") ranges on a logarithmic scale, lists are choices)
SWEEP_RUNS = 30
SWEEP_SMOTE_RATIO = 0.3
SWEEP_SPACE = {
    "shallow_trees": [100, 200, 300, 500], "shallow_depth": [3, 4, 5, 6, 7], "shallow_step": (0.01, 0.3, "log"),
    "shallow_rows": (0.6, 1.0), "shallow_columns": (0.6, 1.0), "shallow_min_rows": [1, 3, 5, 7],
    "deep_trees": [100, 200, 300, 500], "deep_depth": [3, 4, 5, 6, 7], "deep_step": (0.01, 0.3, "log"), "deep_min_rows": [10, 20, 30, 50],
    "use_target_enc": [True, False], "use_geo": [True, False], "use_smote": [True, False], "scale_pos_weight": (2.0, 6.0),
}
SWEEP_ROW_SHARE = SWEEP_COLUMN_SHARE = 0.8  # of the deep learner

# Split ratios
TEST_FRACTION = 0.2
VAL_FRACTION = 0.1
TEMPORAL_TRAIN, TEMPORAL_VAL = 0.7, 0.15
KFOLDS = 5
RECENT_YEARS = 5

# Declared (config-only) rules
VARIANCE_MIN = 0.01
CORRELATION_MAX = 0.95
MAX_FEATURES = 50
MAX_MISSING_DROP = 0.5
MISSING_ALERT = 0.1
MIN_ROWS = 1000
MIN_POSITIVE_SHARE = 0.05
MIN_ROWS_PER_YEAR = 1000
MONITOR_MIN_AUC = 0.75
MONITOR_MIN_ACCURACY = 0.80
MONITOR_MAX_LOG_LOSS = 0.5
MONITOR_RATE_DEVIATION = 0.05
MONITOR_DRIFT = 0.1
AUTO_REJECT_DTI = 0.6
AUTO_REJECT_CONSECUTIVE_LATE = 6
AUTO_REJECT_BANKRUPTCY_YEARS = 2
AUTO_REJECT_FORECLOSURE_YEARS = 3
COND_STABLE_EMPLOYMENT_MONTHS = 24
COND_HIGH_INCOME = 100000
COND_PAYMENT_RATE = 0.95
COND_LOW_UTILIZATION = 0.3
MAX_LATE_PAYMENTS = 3
MAX_MISSED_PAYMENTS = 1
USD_PER_NTD = 0.031

# 7-tier portfolio classification (declared): upper bound of default probability
# (a probability equal to a bound falls in the next tier), tier, action, review
# frequency, provision rate
PROVISION_TIERS = [
    (0.02, "Excellent", "Maintain", "Annual", 0.001),
    (0.05, "Good", "Maintain", "Annual", 0.005),
    (0.10, "Satisfactory", "Monitor", "Semi-Annual", 0.01),
    (0.20, "Watch", "Enhanced Monitor", "Quarterly", 0.03),
    (0.35, "Substandard", "Restructure", "Monthly", 0.10),
    (0.60, "Doubtful", "Workout", "Weekly", 0.50),
    (None, "Loss", "Write-off", "Daily", 1.00),
]

# Importance roll-up: ordered (category, name fragments); first match wins
FEATURE_CATEGORIES = [
    ("Tier 2: Advanced Time Series", ["critical_period", "acceleration", "late_stage", "early_warning",
                                      "rolling", "ema", "recovery", "improving"]),
    ("Tier 1: Overdue Patterns", ["overdue_trend", "overdue_worsening", "max_consecutive", "overdue_frequency",
                                  "overdue_std", "late_overdue", "early_overdue", "total_overdue",
                                  "has_overdue", "recent_overdue"]),
    ("Customer History", ["historical", "prev_", "cumulative", "is_new_customer", "customer_default"]),
    ("WoE Encoded (Categorical)", ["woe"]),
    ("Financial Capability", ["dti", "payment_pressure", "salary", "job"]),
]
OTHER_CATEGORY = "Other Features"

REPORT_TEXT = ["ready to deploy", "tune further", "retrain"]  # by AUC >= .85 / >= .75 / else
