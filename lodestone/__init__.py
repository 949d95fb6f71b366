"""lodestone: repository analytics expressed as Spark DataFrame operators.

Every operator takes and returns DataFrames; nothing in the core package imports
the optional training-data subpackage.
"""

from lodestone.session import local_session

__all__ = ["local_session"]
