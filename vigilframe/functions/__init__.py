"""vigilframe.functions"""
