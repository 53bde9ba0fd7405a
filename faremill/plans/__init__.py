"""Registered queries and the plans behind them."""
