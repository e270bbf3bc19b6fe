"""operators of the examweft engine."""
