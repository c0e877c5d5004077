"""vigilframe.sources"""
