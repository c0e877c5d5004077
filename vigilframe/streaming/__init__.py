"""vigilframe.streaming"""
