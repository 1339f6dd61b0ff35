"""lexaloom.streaming"""
