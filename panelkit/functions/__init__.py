"""Column expressions: keys, ratios, dates, flags."""
