"""tidewrack: content analytics on Spark DataFrames.

Pages, feeds, messages, transcripts and knowledge-base documents are tables;
every operator is a function from DataFrame to DataFrame (or Column to
Column), so Catalyst sees the whole plan.
"""
