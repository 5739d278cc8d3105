"""Schemas, flag bits and period names."""

from __future__ import annotations

#: Bits of a bar's flags, and periods in minutes with their display names.
CLOSED, AUCTION, NIGHT = 1, 2, 4
PERIODS = {1: "1m", 5: "5m", 15: "15m", 30: "30m", 60: "1h", 120: "2h", 240: "4h", 1440: "1d"}
#: Columns of a bar file, in order.
BAR_COLUMNS = ["bar_time", "trading_day", "open", "high", "low", "close", "volume", "turnover", "open_interest", "settlement", "tick_count", "flags"]
#: Exchange time is UTC+8.
EXCHANGE_MS = 8 * 3600 * 1000


#: Schemas as DDL text, which readers take and which needs no session.
TICK = "symbol STRING, seq BIGINT, time TIMESTAMP_NTZ, price DOUBLE, volume DOUBLE, turnover DOUBLE, open_interest DOUBLE, trading_day INT"
BAR = "symbol STRING, period STRING, bar_time TIMESTAMP_NTZ, trading_day INT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, turnover DOUBLE, open_interest DOUBLE, settlement DOUBLE, tick_count INT, flags INT"
SOURCE_TICK = ["TradingDay", "InstrumentID", "UpdateTime", "UpdateMillisec", "LastPrice", "Volume", "Turnover", "OpenInterest"]
EXTERNAL_BAR = ["datetime", "open", "high", "low", "close", "volume", "hold"]
