"""Request routing, dataset building and evaluation as Spark plans."""
