"""Whole plans: the index build, the verbs, and the queries on the star-schema vault."""
