"""galley.operators"""
