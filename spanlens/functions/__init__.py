"""spanlens.functions"""
