"""A vault analytics engine on Spark: notes, chunks, links and rules as DataFrames, with search and graph queries over them."""
