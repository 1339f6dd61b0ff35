"""lexaloom.plans"""
