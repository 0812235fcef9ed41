"""Relational operators on long frames: panel (market, id, date, ret) and series (market, date, ret)."""
