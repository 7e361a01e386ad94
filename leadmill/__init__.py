"""Lead intelligence on Spark: intake, entity resolution, enrichment, scoring, querying."""
