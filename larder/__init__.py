"""larder: recipe-catalogue analytics expressed as Spark DataFrame plans.

Sub-packages
- ``sources``   readers, writers and the recipe view over the driver tables
- ``functions`` reusable Column builders (predicates, text helpers)
- ``operators`` statistics, mapping/validation, publish and tag operators
- ``plans``     the diet classifier, review exchange and prompt builder
- ``streaming`` file-stream publish of JSON batches
"""

from larder.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
