"""lexaloom.functions"""
