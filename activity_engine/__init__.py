"""Activity analytics on Spark: typed ingestion, profiles, text, joins in time and vector space, reports."""
