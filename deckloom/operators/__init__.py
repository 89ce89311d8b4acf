"""DataFrame-to-DataFrame operators. Pure and lazy: no collect, no driver loops over rows."""
