"""cairn.functions"""
