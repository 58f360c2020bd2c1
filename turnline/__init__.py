"""Airline rotation and delay-propagation datasets as PySpark DataFrame jobs."""
