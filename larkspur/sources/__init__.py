"""Rule artifacts, correlation files, event inputs and contributions."""
