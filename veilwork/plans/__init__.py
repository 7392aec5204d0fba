"""Whole analyses, put together from functions and operators."""
