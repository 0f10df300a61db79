"""The expression language of packages, compiled to Spark columns."""

from .compile import Expressions, register_function

__all__ = ["Expressions", "register_function"]
