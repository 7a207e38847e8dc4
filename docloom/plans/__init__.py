"""Plan shapes shared by the operators: top-k, skewed joins, ordered neighbours."""
