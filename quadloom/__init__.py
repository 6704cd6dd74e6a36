"""quadloom: labelled-graph analytics expressed as Spark plans."""
