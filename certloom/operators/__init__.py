"""Query operators: search, held results, certificate retrieval, statistics, verification."""
