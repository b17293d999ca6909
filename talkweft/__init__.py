"""talkweft: conversation-data and corpus operators expressed as Spark DataFrame plans."""
