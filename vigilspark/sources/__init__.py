"""vigilspark.sources"""
