"""Collection analytics on Spark: catalogues of owned things and the money behind them."""
