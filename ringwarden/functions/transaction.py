"""Columns derived from one transaction or one identifier."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BANKS,
    CARD_NETWORKS,
    EDGE_PAYLOAD_FIELDS,
    EMPTY_TOKEN,
    FRAUD_TYPES,
    HOURS_PER_DAY,
    TOKEN_SALT,
    TYPE_CODES,
    UPI_APPS,
    UPI_HANDLES,
)


def is_fraud_type(kind: Column) -> Column:
    return kind.isin(*FRAUD_TYPES)


def type_code(kind: Column) -> Column:
    """0..4; null for a type outside the code list."""
    branches = None
    for name, code in TYPE_CODES.items():
        branches = F.when(kind == name, code) if branches is None else branches.when(kind == name, code)
    return branches.cast("int")


def amount_log(amount: Column) -> Column:
    return F.log1p(amount)


def hour_sin(step: Column) -> Column:
    return F.sin(step * F.lit(2 * math.pi) / HOURS_PER_DAY)


def hour_cos(step: Column) -> Column:
    return F.cos(step * F.lit(2 * math.pi) / HOURS_PER_DAY)


def edge_vector(amount: Column, step: Column) -> Column:
    return F.array(amount_log(amount), hour_sin(step), hour_cos(step))


def edge_payload_vector(fields: dict[str, Column]) -> Column:
    """The 12 numbers of a typed edge in fixed order; velocities default to 1."""
    parts = []
    for name in EDGE_PAYLOAD_FIELDS:
        default = 1.0 if name.startswith("velocity") else 0.0
        value = fields.get(name)
        parts.append(F.lit(default) if value is None else F.coalesce(value.cast("double"), F.lit(default)))
    return F.array(*parts)


def tokenize_identifier(raw: Column, salt: str = TOKEN_SALT) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{salt}::"), raw), 256)
    return F.when(raw.isNull() | (raw == ""), EMPTY_TOKEN).otherwise(
        F.concat(F.lit("tok_"), F.substring(digest, 1, 16))
    )


def entity_id(prefix: str, *key: Column) -> Column:
    """A 14-character id that a retried task computes again, unlike a random one."""
    digest = F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 14))


def hash_number(*parts: Column | str) -> Column:
    """A number below 2^32 that depends only on the given key parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _pick(names: tuple[str, ...], label: str, key: Column) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.element_at(table, (hash_number(label, key) % len(names) + 1).cast("int"))


def _four_digits(label: str, key: Column) -> Column:
    return (hash_number(label, key) % 9000 + 1000).cast("string")


def method_detail(method: Column, key: Column) -> Column:
    """How a payment was made, as shown to a reviewer; picks follow from ``key``."""
    upi = F.concat(
        _pick(UPI_APPS, "app", key), F.lit(" (user_"), _four_digits("vpa", key), _pick(UPI_HANDLES, "handle", key), F.lit(")")
    )
    card = F.concat(_pick(CARD_NETWORKS, "network", key), F.lit(" •••• "), _four_digits("card", key))
    bank = F.concat(F.lit("NetBanking ("), _pick(BANKS, "bank", key), F.lit(")"))
    return F.when(method == "upi", upi).when(method == "card", card).otherwise(bank)


def nan_to_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
