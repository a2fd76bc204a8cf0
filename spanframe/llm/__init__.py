"""Training-data operators: scoring, filtering, joins, packing and archive files over document tables."""
