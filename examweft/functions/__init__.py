"""functions of the examweft engine."""
