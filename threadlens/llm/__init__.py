"""Training-data operators: packing, near-duplicate and substring removal, quality, personal data, archives,
exact vector search, language-model scoring and byte-pair encoding. Nothing else in the library imports this package."""
