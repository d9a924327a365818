"""Per-stream sequential state: the same pure folds serve batches and streams."""
