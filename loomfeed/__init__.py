"""Feed, page and corpus analytics expressed as Spark DataFrame plans."""
