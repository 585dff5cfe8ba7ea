"""lexloom.functions"""
