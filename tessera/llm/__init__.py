"""Training-data operators: deduplication, counting, classification, packing, search and scans."""
