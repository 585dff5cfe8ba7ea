"""lexloom.operators"""
