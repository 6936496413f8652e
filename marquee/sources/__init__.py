"""Sources and sinks: schemas, derived inputs, files, small inline tables."""
