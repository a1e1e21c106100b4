"""clueforge.streaming"""
