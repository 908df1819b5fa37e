"""Query catalogue, SQL oracles, the batch run and its command line."""
