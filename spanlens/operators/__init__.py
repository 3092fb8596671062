"""spanlens.operators"""
