"""folio: a document-intelligence query engine expressed as Spark DataFrames."""
