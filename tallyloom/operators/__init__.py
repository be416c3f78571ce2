"""tallyloom.operators"""
