"""streaming of the examweft engine."""
