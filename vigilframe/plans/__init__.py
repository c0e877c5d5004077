"""vigilframe.plans"""
