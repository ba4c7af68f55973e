"""tarnmill.sources"""
