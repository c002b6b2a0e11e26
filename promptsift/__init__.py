"""promptsift: context reduction and corpus preparation as Spark DataFrame plans."""
