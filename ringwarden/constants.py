"""Fixed values that results depend on, stated once.

Everything here is a code, a name list, a weight or a limit that has to have
exactly this value for scores, features and reports to come out right.
"""

from __future__ import annotations

# --- fixed values: transactions ------------------------------------------------
TYPE_CODES = {"PAYMENT": 0, "TRANSFER": 1, "CASH_OUT": 2, "DEBIT": 3, "CASH_IN": 4}
FRAUD_TYPES = ("TRANSFER", "CASH_OUT")
NIGHT_LAST_STEP = 6
HOURS_PER_DAY = 24

# --- fixed values: the 22 account features, in vector order ---------------------
TABULAR_FEATURES = (
    "total_sent_log",
    "total_received_log",
    "tx_count_out",
    "tx_count_in",
    "unique_dest_count",
    "unique_src_count",
    "avg_sent_log",
    "avg_received_log",
    "balance_drain_ratio",
    "night_tx_fraction",
    "fraud_type_fraction",
)
STRUCTURAL_FEATURES = (
    "in_degree",
    "out_degree",
    "degree_ratio",
    "pagerank",
    "k_core_number",
    "local_clustering_coefficient",
)
TEMPORAL_FEATURES = (
    "tx_velocity_24h",
    "tx_velocity_7d",
    "amount_velocity_24h",
    "amount_velocity_7d",
    "amount_spike_ratio",
)
FEATURES = TABULAR_FEATURES + STRUCTURAL_FEATURES + TEMPORAL_FEATURES
UNIT_INTERVAL_FEATURES = (
    "night_tx_fraction",
    "fraud_type_fraction",
    "local_clustering_coefficient",
)
UNBOUNDED_FEATURES = ("balance_drain_ratio",)
MAX_BATCH_ACCOUNTS = 10_000

# --- fixed values: importance weights used by the linear attribution ------------
IMPORTANCE_WEIGHTS = {
    "total_sent_log": 0.04,
    "total_received_log": 0.03,
    "tx_count_out": 0.03,
    "tx_count_in": 0.02,
    "unique_dest_count": 0.03,
    "unique_src_count": 0.02,
    "avg_sent_log": 0.02,
    "avg_received_log": 0.02,
    "balance_drain_ratio": 0.22,
    "night_tx_fraction": 0.11,
    "fraud_type_fraction": 0.10,
    "in_degree": 0.04,
    "out_degree": 0.05,
    "degree_ratio": 0.15,
    "pagerank": 0.03,
    "k_core_number": 0.02,
    "local_clustering_coefficient": 0.06,
    "tx_velocity_24h": 0.08,
    "tx_velocity_7d": 0.03,
    "amount_velocity_24h": 0.03,
    "amount_velocity_7d": 0.03,
    "amount_spike_ratio": 0.11,
}
# feature -> (baseline, scale, sign)
ATTRIBUTION_TERMS = {
    "balance_drain_ratio": (0.35, 3.5, 1.0),
    "degree_ratio": (1.2, 0.4, 1.0),
    "night_tx_fraction": (0.15, 2.0, 1.0),
    "amount_spike_ratio": (1.0, 0.8, 1.0),
    "local_clustering_coefficient": (0.15, 4.0, -1.0),
    "tx_velocity_24h": (5.0, 0.05, 1.0),
}

# --- fixed values: money, thresholds, tiers -------------------------------------
COST_FALSE_POSITIVE = 350.0
COST_FALSE_NEGATIVE = 42_000.0
FLAG_THRESHOLD = 0.42
COUNTERFACTUAL_TARGET = 0.35
DEPLOYED_BASE_RATE = 0.0013
TIERS = ((0.80, "CRITICAL"), (0.50, "HIGH"), (0.20, "MEDIUM"))
PSI_WARN = 0.10
PSI_ALERT = 0.20
DEFAULT_SCORE = 0.1
CACHE_TTL_SECONDS = 86_400

# --- fixed values: counterfactual steps (feature, target, direction) ------------
COUNTERFACTUAL_STEPS = (
    ("balance_drain_ratio", 0.25, "down"),
    ("degree_ratio", 1.2, "down"),
    ("night_tx_fraction", 0.10, "down"),
    ("amount_spike_ratio", 1.0, "down"),
    ("local_clustering_coefficient", 0.22, "up"),
)

# --- fixed values: identifier tokens --------------------------------------------
TOKEN_SALT = "account_token_salt"
EMPTY_TOKEN = "tok_empty"

# --- fixed values: typed graph --------------------------------------------------
NODE_TYPES = (
    "merchant", "customer", "transaction", "payment_instrument", "upi_vpa",
    "bank_account", "device", "ip", "asn", "phone", "email", "address",
    "pincode_or_geohash", "promo", "order", "shipment", "refund", "chargeback",
    "product_sku", "session",
)
RELATIONS = (
    ("customer", "PLACED", "transaction"),
    ("transaction", "BELONGS_TO", "merchant"),
    ("transaction", "USED_DEVICE", "device"),
    ("transaction", "FROM_IP", "ip"),
    ("ip", "IN_ASN", "asn"),
    ("transaction", "USED_PAYMENT", "payment_instrument"),
    ("transaction", "USED_VPA", "upi_vpa"),
    ("customer", "HAS_BANK_ACCOUNT", "bank_account"),
    ("merchant", "PAYOUT_TO", "bank_account"),
    ("transaction", "DELIVERED_TO", "address"),
    ("address", "IN_PINCODE", "pincode_or_geohash"),
    ("customer", "HAS_PHONE", "phone"),
    ("customer", "HAS_EMAIL", "email"),
    ("transaction", "USED_PROMO", "promo"),
    ("transaction", "CONTAINS", "product_sku"),
    ("transaction", "HAS_ORDER", "order"),
    ("order", "HAS_SHIPMENT", "shipment"),
    ("transaction", "GENERATED_REFUND", "refund"),
    ("transaction", "GENERATED_CHARGEBACK", "chargeback"),
    ("customer", "HAS_SESSION", "session"),
    ("session", "USED_DEVICE", "device"),
    ("session", "FROM_IP", "ip"),
)
NEIGHBOR_CAPS = {
    "USED_DEVICE": 8,
    "DELIVERED_TO": 8,
    "USED_PAYMENT": 8,
    "USED_VPA": 8,
    "USED_PROMO": 16,
    "FROM_IP": 4,
    "BELONGS_TO": 16,
    "PLACED": 16,
    "HAS_BANK_ACCOUNT": 8,
    "PAYOUT_TO": 8,
}
NEIGHBOR_CAP_DEFAULT = 12
EDGE_PAYLOAD_FIELDS = (
    "delta_t_from_prev", "amount", "refund_amount", "chargeback_flag", "rto_flag",
    "promo_discount_amount", "device_novelty_flag", "ip_novelty_flag",
    "address_novelty_flag", "velocity_5m", "velocity_1h", "velocity_24h",
)
# identifier kinds that link two payments into one ring
LINK_KINDS = ("device_id", "ip_id", "address_id", "promo_id", "bank_account_id")

# --- fixed values: merchant categories and payment methods ----------------------
# mcc, name, average ticket, base risk
MERCHANT_CATEGORIES = (
    ("5732", "Electronics & Gadgets", 14500.0, 0.04),
    ("5651", "Fashion & Lifestyle", 2400.0, 0.02),
    ("5812", "Quick-Commerce & Delivery", 480.0, 0.01),
    ("5999", "Digital Vouchers & Gaming", 3200.0, 0.07),
)
# method, share of traffic
PAYMENT_METHODS = (("upi", 0.68), ("card", 0.24), ("netbanking", 0.08))
UPI_APPS = ("Google Pay", "PhonePe", "Paytm UPI", "CRED UPI", "BHIM UPI", "WhatsApp Pay")
UPI_HANDLES = ("@okhdfcbank", "@okaxis", "@paytm", "@ybl", "@ibl", "@ptaxis", "@apl")
BANKS = ("HDFC", "ICICI", "SBI", "Axis", "Kotak", "Punjab National Bank")
CARD_NETWORKS = ("RuPay", "Visa", "Mastercard")

AUDIT_COLUMNS = (
    "audit_id", "account_id", "decision", "analyst_id",
    "risk_score", "action_taken", "notes", "timestamp",
)
