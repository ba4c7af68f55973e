"""tarnmill.operators"""
