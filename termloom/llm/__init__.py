"""Operations of a training-data pipeline: each works on a DataFrame of documents.

Nothing outside this subpackage imports it; ``termloom.llm.queries`` registers its queries.
"""
