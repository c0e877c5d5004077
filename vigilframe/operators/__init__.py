"""vigilframe.operators"""
