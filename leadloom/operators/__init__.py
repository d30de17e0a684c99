"""leadloom.operators"""
