from pricewright.sources.listings import listings, read_table, ORD_COLS  # noqa: F401
