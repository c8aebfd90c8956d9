"""Plumbline: a PySpark-native engine for synthetic data, fidelity and exam work."""
