"""framelake: frame stacking and session analytics as Spark DataFrame plans."""
