"""Analytics for ground-penetrating-radar surveys on Spark: one row for each trace, samples as an array."""
