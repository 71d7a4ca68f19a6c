"""Operations of a training-data pipeline, each on whole tables.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin contract queries; every other module is one operator with its own general
interface.
"""
