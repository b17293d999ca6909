"""talkweft.operators"""
