"""lexaloom.operators"""
