"""Operations for preparing language-model training data.

Every operator takes a DataFrame and returns a DataFrame.  Nothing outside this subpackage imports it.
"""
