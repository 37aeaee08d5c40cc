"""Whole evaluations made of the operators, their reports, and the registered queries."""
