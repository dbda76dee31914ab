"""Training-data operators on documents: deduplication, filters, tokenisation, packing. Nothing else imports this package."""
