"""Plans: the end-to-end pipeline and the registered queries with their SQL twins."""
