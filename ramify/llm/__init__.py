"""Operations of a large-scale training-data pipeline, as DataFrame -> DataFrame functions.

Nothing outside this subpackage imports it.
"""
