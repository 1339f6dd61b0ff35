"""lexaloom.sources"""
