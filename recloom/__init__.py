"""Recommendation analytics on Spark: batch features, trailing activity, policy,
bulk ranking, traces and drift monitoring, all as DataFrame plans."""
