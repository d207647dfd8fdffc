"""Training-data operators: scans, joins, classifiers and packing over `documents`, `embeddings` and `pages`."""
