"""clueforge.operators"""
