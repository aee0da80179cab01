"""strata: layered images, and the data pipelines around them, as Spark plans."""
