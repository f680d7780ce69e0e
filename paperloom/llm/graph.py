"""Connected components, as the library has them."""

from ..operators.graph import components, is_forest_of_stars

__all__ = ["components", "is_forest_of_stars"]
