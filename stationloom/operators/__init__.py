"""DataFrame operators: normalisation, joins, sampling, quality, features, evaluation, spatial, models."""
