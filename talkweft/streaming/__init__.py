"""talkweft.streaming"""
