"""Weights, thresholds, code lists and windows of the score model."""

# --- forms -------------------------------------------------------------------
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")
QUARTERLY_FORMS = ("10-Q", "10-Q/A")
ANCHOR_FORMS = ANNUAL_FORMS + QUARTERLY_FORMS
BEHAVIOR_HISTORY_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
INSIDER_FORMS = ("4", "4/A")
SIGNAL_JOB_FORMS = ("10-K", "10-Q")
SUPPORTED_INDEX_FORMS = ("10-K", "10-Q", "8-K", "4", "4/A", "DEF 14A", "SC 13G", "SC 13D")
DEFAULT_TAXONOMIES = ("us-gaap", "ifrs-full", "dei")

# --- carry-forward -----------------------------------------------------------
CARRY_FORWARD_FILINGS = 2
CARRY_FORWARD_PENALTY = 0.95

# --- text --------------------------------------------------------------------
FORWARD_LOOKING_KEYWORDS = (
    "expect", "expects", "expecting", "outlook", "guidance", "forecast",
    "anticipate", "anticipates", "believe", "believes", "will", "would",
    "could", "may", "plan", "plans", "continue", "continuing", "headwind",
    "headwinds", "uncertain", "challenge", "challenges",
)
TEXT_WEIGHTS = {"tfidf_drift": 0.40, "semantic_novelty": 0.60}
TEXT_CONFIDENCE_TARGET = 8
DRIFT_FLOOR = 0.01
DRIFT_CAP = 0.08
TOPK_RATIO = 0.25
TOPK_MIN = 3
DRIFT_SENTENCE_MIN_CHARS = 40
DRIFT_HISTORY_MIN = 3
DRIFT_HISTORY_MIN_STD = 0.005
DRIFT_Z_CAP = 2.0
TONE_SECTIONS = ("mda", "forward_looking")

# --- chunking ----------------------------------------------------------------
CHUNK_TARGET = 1500
CHUNK_MAX = 1800
CHUNK_MIN = 300
CHUNK_OVERLAP = 150
SECTION_ORDER = {"business": 10, "risk_factors": 20, "forward_looking": 30, "mda": 40}

# --- sections ----------------------------------------------------------------
ANNUAL_ITEMS = {"1": "business", "1A": "risk_factors", "7": "mda"}
QUARTERLY_ITEMS = {"1A": "risk_factors", "2": "mda"}
ITEM_CODES = ("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8",
              "9", "9A", "10", "11", "12", "13", "14", "15")
FORWARD_SECTION_PHRASES = (
    r"forward[-\s]looking statements",
    r"special note regarding forward",
    r"cautionary statement",
    r"cautionary language",
)
STOP_PHRASES = (r"\bsignatures\b", r"\bexhibit\s+index\b")
HEADING_MAX_CHARS = 220
SECTION_MIN_CHARS = 200
BLOCK_MIN_CHARS = 8

# --- numbers -----------------------------------------------------------------
FACT_ALIASES = {
    "revenue": (
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "RevenueFromContractWithCustomerExcludingAssessedTaxNetOfReturns",
        "SalesRevenueNet",
    ),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss", "IncomeFromOperations", "OperatingIncome"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "assets": ("Assets",),
    "liabilities": ("Liabilities", "LiabilitiesAndStockholdersEquity"),
    "equity": (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "long_term_debt": (
        "LongTermDebt",
        "LongTermDebtNoncurrent",
        "LongTermDebtAndCapitalLeaseObligations",
    ),
    "cash": (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ),
    "operating_cash_flow": (
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ),
    "shares_outstanding": (
        "CommonStockSharesOutstanding",
        "EntityCommonStockSharesOutstanding",
        "CommonStocksIncludingAdditionalPaidInCapitalSharesOutstanding",
    ),
}
DURATION_FACTS = ("revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow")
SUMMARY_FACTS = {
    "revenue": "revenue",
    "net_income": "net_income",
    "gross_profit": "gross_profit",
    "operating_income": "operating_income",
    "total_assets": "assets",
    "total_debt": "long_term_debt",
}
MARGIN_WEIGHTS = {"gross_margin": 0.35, "operating_margin": 0.40, "net_margin": 0.25}
BALANCE_WEIGHTS = {"leverage_score": 0.35, "cash_score": 0.30, "cf_quality_score": 0.35}
EARNINGS_WEIGHTS = {"accruals_score": 0.45, "cash_conversion_score": 0.35, "consistency_score": 0.20}
CONSISTENCY_WEIGHTS = {"cash_conversion_shift": 0.60, "accruals_shift": 0.40}
HISTORY_LIMIT = 8
ANOMALY_METRICS = ("gross_margin", "operating_margin", "revenue_growth", "debt_to_equity")
ANOMALY_MIN_HISTORY = 4
ANOMALY_MIN_STD = 0.001

# --- insider behaviour -------------------------------------------------------
TRANSACTION_TYPES = {
    "P": "open_market_buy", "S": "open_market_sell", "M": "option_exercise",
    "A": "equity_award", "F": "tax_withholding", "G": "gift",
    "C": "conversion", "D": "issuer_transaction",
}
ROUTINE_CODES = ("A", "F", "M")
COMP_LINK_CODES = ("A", "F", "M", "G")
COMP_LINK_DAYS = 7
OPPORTUNISTIC_ROLES = ("CEO", "CFO", "President", "Director")
ROLE_WEIGHTS = {"CEO": 1.00, "CFO": 0.90, "President": 0.85, "COO": 0.80,
                "Director": 0.60, "Other Officer": 0.50}
OPPORTUNISTIC_MIN_SHARES = 1000.0
BEHAVIOR_DAYS_BEFORE = 90
BEHAVIOR_DAYS_AFTER = 90
GOVERNANCE_DAYS = 365
GOVERNANCE_CAP = 0.30
GOVERNANCE_MULTIPLIER = 0.50
LATE_BUSINESS_DAYS = 2

# --- market ------------------------------------------------------------------
MOMENTUM_WINDOWS = ((30, 0.40, "return_1m"), (90, 0.30, "return_3m"),
                    (180, 0.20, "return_6m"), (365, 0.10, "return_12m"))
VOL_RECENT = 30
VOL_BASE = 180
MIN_PEERS = 3
MARKET_WEIGHTS = {"price_momentum_risk": 0.40, "volatility_spike": 0.35,
                  "market_fundamental_divergence": 0.25}

# --- news --------------------------------------------------------------------
LABEL_SCORES = {"positive": 0.5, "bullish": 0.5, "neutral": 0.0,
                "mixed": -0.1, "negative": -0.5, "bearish": -0.5}
SENTIMENT_WEIGHTS = {"news_sentiment_signal": 0.70, "news_volume_spike": 0.30}
NEWS_WINDOW_DAYS = 90
NEWS_DECAY_DAYS = 15.0
GARBAGE_HEADLINES = ("untitled", "no title", "rss")
AGGREGATOR_HOSTS = ("google.com", "www.google.com", "news.google.com")
TRACKING_KEYS = ("guccounter", "guce_referrer", "guce_referrer_sig", "oc")

# --- composite ---------------------------------------------------------------
COMPOSITE_WEIGHTS = {
    "rlds": 0.20, "mda_drift": 0.08, "forward_pessimism": 0.07,
    "fundamental_deterioration": 0.18, "balance_sheet_stress": 0.07,
    "revenue_growth_deceleration": 0.05, "earnings_quality": 0.05,
    "numeric_anomaly": 0.00, "insider_signal": 0.10, "market_signal": 0.10,
    "sentiment_signal": 0.10,
}
CONVERGENCE_THRESHOLDS = {"text": 0.25, "numeric": 0.20, "behavior": 0.15,
                          "market": 0.20, "sentiment": 0.20}
CONVERGENCE_LAYERS = {
    "text": ("rlds", "forward_pessimism"),
    "numeric": ("fundamental_deterioration", "balance_sheet_stress"),
    "behavior": ("insider_signal",),
    "market": ("market_signal",),
    "sentiment": ("sentiment_signal",),
}
CONVERGENCE_TIERS = {5: ("full", 0.20), 4: ("strong", 0.15), 3: ("moderate", 0.10)}
CRITICAL_LAYERS = {
    "text": ("rlds", "mda_drift", "forward_pessimism"),
    "numeric": ("fundamental_deterioration", "balance_sheet_stress",
                "revenue_growth_deceleration", "earnings_quality", "numeric_anomaly"),
    "behavior": ("insider_signal",),
}
COVERAGE_HIGH = 0.80
COVERAGE_MEDIUM = 0.60
MIN_COVERAGE = 0.60
RAW_MIN = 0.04
RAW_MAX = 0.35
SNAPSHOT_COLUMNS = {
    "rlds": "signal_text", "mda_drift": "signal_mda", "forward_pessimism": "signal_pessimism",
    "fundamental_deterioration": "signal_fundamental", "balance_sheet_stress": "signal_balance",
    "revenue_growth_deceleration": "signal_growth", "earnings_quality": "signal_earnings",
    "numeric_anomaly": "signal_anomaly", "insider_signal": "signal_insider",
    "market_signal": "signal_market", "sentiment_signal": "signal_sentiment",
}

# --- validation report -------------------------------------------------------
VALIDATION_SIGNALS = (
    ("signal_text", "text_drift", "Text Drift"),
    ("signal_fundamental", "fundamentals", "Fundamentals"),
    ("signal_balance", "balance", "Balance"),
    ("signal_growth", "growth", "Growth"),
    ("signal_earnings", "earnings_quality", "Earnings Quality"),
    ("signal_anomaly", "anomaly", "Anomaly"),
    ("signal_insider", "insider", "Insider"),
    ("signal_market", "market", "Market"),
    ("signal_sentiment", "sentiment", "Sentiment"),
)
FLAT_RANGE = 0.05
ALWAYS_HIGH = 0.75

# --- macro -------------------------------------------------------------------
DEFAULT_MACRO_SERIES = ("CPIAUCSL", "FEDFUNDS", "DGS10", "UNRATE", "INDPRO", "VIXCLS", "BAA10Y")

# --- signal catalogue (name, layer, what it measures) ------------------------
SIGNAL_CATALOGUE = (
    ("rlds", "text", "Change of the risk section against the previous comparable filing"),
    ("mda_drift", "text", "Change of the management discussion against the previous comparable filing"),
    ("forward_pessimism", "text", "Negative against positive tone of forward-looking paragraphs"),
    ("text_sentiment", "text", "Mean positive tone of management and forward-looking paragraphs"),
    ("narrative_numeric_divergence", "composite", "Gap between narrative risk and numeric risk"),
    ("fundamental_deterioration", "numbers", "Decline of gross, operating and net margin"),
    ("revenue_growth_deceleration", "numbers", "Slowdown of revenue growth"),
    ("balance_sheet_stress", "numbers", "Leverage rise, cash drop and weak cash backing of income"),
    ("earnings_quality", "numbers", "Accruals, weak cash conversion and unstable conversion"),
    ("numeric_anomaly", "numbers", "Distance of current metrics from the company's own history"),
    ("ita", "behavior", "Opportunistic insider selling against buying"),
    ("insider_concentration", "behavior", "Number of insiders selling at the same time"),
    ("insider_signal", "behavior", "Selling asymmetry, concentration and late reporting combined"),
    ("price_momentum_risk", "market", "Weighted negative returns over four horizons"),
    ("volatility_spike", "market", "Recent against longer-run volatility"),
    ("market_fundamental_divergence", "market", "Price to earnings against the sector median"),
    ("market_signal", "market", "Momentum, volatility and valuation combined"),
    ("news_sentiment_signal", "sentiment", "Decayed news tone and its deterioration"),
    ("news_volume_spike", "sentiment", "News count of the last week against the usual week"),
    ("sentiment_signal", "sentiment", "News tone and volume combined"),
    ("convergence_signal", "composite", "Boost for evidence layers elevated together"),
    ("nci_global", "composite", "Fused score of all layers"),
    ("composite_filing_risk", "composite", "Second name of the fused score"),
)
