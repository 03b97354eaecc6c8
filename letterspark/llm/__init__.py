"""Operations for preparing large text collections for model training.

Nothing else in the package imports this subpackage; ``letterspark.llm.queries``
lists its registered queries and their SQL.
"""
