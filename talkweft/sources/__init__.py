"""talkweft.sources"""
