"""galley.streaming"""
