"""Group-aware evaluation of predictors, expressed as Spark DataFrame plans."""
