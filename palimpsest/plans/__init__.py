"""Plans that derive block logs from the benchmark tables."""
