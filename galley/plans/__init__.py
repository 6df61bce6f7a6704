"""galley.plans"""
