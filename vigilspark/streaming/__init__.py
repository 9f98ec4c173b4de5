"""vigilspark.streaming"""
