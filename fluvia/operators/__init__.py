"""Operators from DataFrame to DataFrame; arguments are Columns, SQL strings or plain values."""
