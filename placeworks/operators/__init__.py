"""DataFrame transforms: predicates, joins, aggregates, ranking, sets, linkage, hours, review states."""
