"""Catalogue curation on Spark: normalise, match, de-duplicate, score, reconcile."""
