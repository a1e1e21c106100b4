"""clueforge.sources"""
