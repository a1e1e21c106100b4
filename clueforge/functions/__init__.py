"""clueforge.functions"""
