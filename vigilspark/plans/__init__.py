"""vigilspark.plans"""
