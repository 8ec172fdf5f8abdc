"""Training-data operators: de-duplication, filtering, tokenising, packing and storage of text."""
