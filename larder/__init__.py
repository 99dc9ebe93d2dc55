"""Food-label analytics on Spark: search, history, ingredient risk, nutrition text, attempts, layout, metrics."""
