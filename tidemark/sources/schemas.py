"""Declared input schemas, so that no file is scanned to infer one."""

from __future__ import annotations

LEDGER = """
    user_id BIGINT, trxn_id BIGINT, trxn_type STRING, trxn_datetime TIMESTAMP_NTZ,
    acc_opening_datetime TIMESTAMP_NTZ, acc_maturity_datetime TIMESTAMP_NTZ,
    balance DECIMAL(18,2), tpv DECIMAL(18,2), service STRING, country STRING, channel STRING
"""

REGISTRATIONS = """
    user_id BIGINT, trxn_datetime TIMESTAMP_NTZ, signup_datetime TIMESTAMP_NTZ,
    trxn_type STRING, country STRING, channel STRING, customer_acquisition_cost DECIMAL(18,4)
"""

MARKET = "country STRING, population BIGINT"

# start and stop are text, day first; parsed by clean_sessions
SESSIONS = """
    TransactionId BIGINT, UTCTransactionStart STRING, UTCTransactionStop STRING,
    ConnectedTime DOUBLE, ChargeTime DOUBLE, TotalEnergy DOUBLE, MaxPower DOUBLE
"""

HOLIDAYS = "date DATE"
