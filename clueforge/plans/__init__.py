"""clueforge.plans"""
