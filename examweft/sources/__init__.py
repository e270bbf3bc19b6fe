"""sources of the examweft engine."""
