"""Operators: functions from DataFrames to DataFrames.

Operators that join on a key of any skew first run jobs on counts of that key, which become
scratch tables (see ``docloom.plans.shapes``); all others are lazy unless their docstring says
otherwise.
"""
