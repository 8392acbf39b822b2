"""Reading and writing annotations, event logs, parameters and splits."""
