"""loomcat: a product-catalogue engine expressed as Spark DataFrame jobs."""
