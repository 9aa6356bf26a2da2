"""quantloom.kernels"""
