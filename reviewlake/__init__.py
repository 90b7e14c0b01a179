"""Review analytics on Spark: cleaning, corpus building, statistics, similarity and probes as DataFrame functions."""
