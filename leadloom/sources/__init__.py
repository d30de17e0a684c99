"""leadloom.sources"""
