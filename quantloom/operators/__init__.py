"""quantloom.operators"""
