"""Flows: their model, the planner and control flow."""

from .flow import Flow, Node, Package
from .run import Result, plan, run

__all__ = ["Flow", "Node", "Package", "Result", "plan", "run"]
