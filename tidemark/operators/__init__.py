"""Features, labels, validation, evaluation, statistics and training over market tables."""
