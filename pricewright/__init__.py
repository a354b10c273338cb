"""pricewright: a PySpark engine for shop-catalogue cleaning and price modelling.

Everything is expressed as DataFrame / SQL operations so Catalyst can prune,
push down and pick join strategies; Python runs on executors only for HTML
extraction and for a caller-supplied enrichment client.
"""

__version__ = "0.1.0"
