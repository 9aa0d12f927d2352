"""Operators for preparing training data: mixing, packing, counting, classifying and de-duplicating documents."""
