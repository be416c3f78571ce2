"""tallyloom.streaming"""
