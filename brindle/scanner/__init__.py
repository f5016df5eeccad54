"""The per-file scanner: pure functions from a file's text to its findings, run in Arrow batches by ``brindle.operators.files_scan``."""
