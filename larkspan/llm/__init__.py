"""Training-data operators: quality ledger, packing, search, personal data, sharding, line and document
near-duplicates, token counts, piece encoding and web archives.  Nothing outside this folder imports it."""
