"""tallyloom.sources"""
