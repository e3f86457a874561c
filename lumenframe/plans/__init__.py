"""Request trees: predicates and expressions, parsed to nodes and turned into Spark columns."""
