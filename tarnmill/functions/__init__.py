"""tarnmill.functions"""
