"""Spark-first analytics over keyed, immutable event feeds."""
