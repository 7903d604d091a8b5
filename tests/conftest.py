import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ringwarden.session import build_session  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


TXN_DDL = (
    "tx_id int, step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, "
    "nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int"
)


def transactions(spark, rows):
    """rows: (step, type, amount, origin, old balance, new balance, destination, fraud)."""
    return spark.createDataFrame(
        [
            (i, s, kind, float(a), o, float(old), float(new), d, 0.0, float(a), y, 0)
            for i, (s, kind, a, o, old, new, d, y) in enumerate(rows)
        ],
        TXN_DDL,
    )


@pytest.fixture(scope="session")
def txn6(spark):
    return transactions(spark, [
        (1, "TRANSFER", 1000, "C001", 5000, 4000, "C002", 1),
        (2, "CASH_OUT", 2000, "C001", 4000, 2000, "C003", 0),
        (3, "PAYMENT", 500, "C002", 1000, 500, "C004", 0),
        (4, "TRANSFER", 3000, "C003", 6000, 3000, "C005", 1),
        (5, "CASH_OUT", 1500, "C004", 3000, 1500, "C001", 0),
        (6, "TRANSFER", 800, "C005", 2000, 1200, "C002", 0),
    ])


@pytest.fixture(scope="session")
def txn10(spark):
    return transactions(spark, [
        (i + 1, "TRANSFER" if i % 2 == 0 else "CASH_OUT", 1000 * (i + 1), f"C00{i % 3}", 5000, 4000, f"C00{(i + 1) % 3}", int(i in (0, 3)))
        for i in range(10)
    ])


@pytest.fixture(scope="session")
def txn100(spark):
    return transactions(spark, [
        (i % 10 + 1, "TRANSFER" if i % 2 else "CASH_OUT", 100 + 13 * i, f"C{(i * 7 + i // 10) % 15:03d}", 5000, 5000 - i, f"D{(i * 11 + i * i // 7) % 15:03d}", int(i % 10 == 3))
        for i in range(100)
    ])
