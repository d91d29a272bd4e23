"""DataFrame operators: normalisation, validation, matching, summaries."""
