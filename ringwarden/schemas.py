"""Fixed row types; nothing in this library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import FEATURES


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """``name TYPE, ...``; usable before a session exists, unlike ``fromDDL``."""
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TRANSACTION = _struct(
    "step INT, type STRING, amount DOUBLE, nameOrig STRING, oldbalanceOrg DOUBLE, "
    "newbalanceOrig DOUBLE, nameDest STRING, oldbalanceDest DOUBLE, newbalanceDest DOUBLE, "
    "isFraud INT, isFlaggedFraud INT"
)

PAYMENT = _struct(
    "transaction_id STRING, customer_id STRING, merchant_id STRING, device_id STRING, "
    "ip_id STRING, address_id STRING, promo_id STRING, bank_account_id STRING, "
    "amount DOUBLE, timestamp DOUBLE, rto_flag INT, chargeback_flag INT"
)

PAYLOAD = T.StructType(
    [
        T.StructField("transactions", T.ArrayType(PAYMENT)),
        T.StructField("risk_scores", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

ACCOUNT_FEATURES = T.StructType(
    [T.StructField("account_id", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)

FEATURE_RECORD = T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])

AUDIT_REQUEST = _struct(
    "account_id STRING, decision STRING, analyst_id STRING, risk_score DOUBLE, "
    "notes STRING, action_taken STRING, requested_at TIMESTAMP"
)

EVENT = _struct(
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

PAYMENT_EVENT = _struct(
    "payment_id STRING, order_id STRING, account_id STRING, merchant_name STRING, mcc_code STRING, "
    "amount_inr DOUBLE, method STRING, method_detail STRING, timestamp TIMESTAMP, ip_hash STRING, "
    "device_fingerprint STRING, risk_score DOUBLE, risk_tier STRING, is_planted_ring BOOLEAN, "
    "ring_type STRING, recommended_action STRING, human_confirmation_required BOOLEAN"
)
