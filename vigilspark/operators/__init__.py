"""vigilspark.operators"""
