"""leadloom.plans"""
