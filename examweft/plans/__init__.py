"""plans of the examweft engine."""
