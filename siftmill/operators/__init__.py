"""DataFrame operators: filters, sampling, ranking, joins, nearest neighbours, evaluation."""
