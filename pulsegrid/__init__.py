"""Electrocardiogram waveform analytics on Spark: DataFrame operators, sources, plans and streams."""
