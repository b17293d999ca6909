"""talkweft.plans"""
