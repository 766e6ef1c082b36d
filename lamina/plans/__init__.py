"""Plan-time schema algebra; no Spark job runs here."""
