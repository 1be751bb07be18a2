"""Starloom: image time series, their calibration, background subtraction and detection statistics as Spark plans."""
