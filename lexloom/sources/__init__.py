"""lexloom.sources"""
