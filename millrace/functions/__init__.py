"""Scalar expressions and monoids."""
