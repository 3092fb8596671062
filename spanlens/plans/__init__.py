"""spanlens.plans"""
