"""Training-data operators: classifiers, deduplication, decontamination, packing and WARC."""
