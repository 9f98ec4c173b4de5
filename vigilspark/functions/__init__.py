"""vigilspark.functions"""
