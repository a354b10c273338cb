"""Column -> Column helpers. All of them are built-in Spark expressions, so
they stay inside whole-stage codegen (no Python UDF)."""

from pricewright.functions.text import (  # noqa: F401
    WS_CLASS, clean_str, ws_trim, is_blank_token, needs_enrichment, needs_make,
    word_count, name_tokens, strip_fence, truthy, na_to_null,
)
from pricewright.functions.prices import (  # noqa: F401
    clean_price, parse_price, parse_price_range, price_text_rule, currency_search,
    finite_positive, price_band, log_target, inverse_target,
)
from pricewright.functions.years import clean_year  # noqa: F401
from pricewright.functions.urls import absolute_url, page_url  # noqa: F401
