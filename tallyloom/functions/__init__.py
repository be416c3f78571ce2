"""tallyloom.functions"""
