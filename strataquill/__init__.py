"""strataquill: retrieval and document analytics expressed as Spark plans."""
