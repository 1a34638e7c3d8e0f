"""itcflow: GST input-tax-credit analytics as Spark jobs."""
