"""corrello: report-correlation analytics expressed as Spark DataFrame plans."""
