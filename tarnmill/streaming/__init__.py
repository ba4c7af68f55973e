"""tarnmill.streaming"""
