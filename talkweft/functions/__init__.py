"""talkweft.functions"""
