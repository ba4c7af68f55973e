"""tarnmill.plans"""
