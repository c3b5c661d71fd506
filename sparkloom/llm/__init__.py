"""Operators for training-data pipelines. Nothing else in sparkloom imports this subpackage."""
