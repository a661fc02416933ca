"""Match analytics on Spark: silver cleaning, form and rating features, outcome models and training-data operators."""
