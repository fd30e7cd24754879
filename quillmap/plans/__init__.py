"""Stages composed of operators, and the registered queries."""
